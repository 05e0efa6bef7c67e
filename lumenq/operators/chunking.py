"""Documents and papers to ordered chunks, and the transforms of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import blank, squeeze, strip
from lumenq.operators.postings import lots

MIN_CHARS, MERGE_CHARS, MAX_CHARS = 80, 200, 1600
LINES_PER_SECTION = 5
_STRIDE = 1_000_000


def paper_chunks(papers: DataFrame, min_chars: int = 0) -> DataFrame:
    """Paragraph chunks of papers (paper_id, title, full_text). Sections and paragraphs are counted before blank ones go."""
    sections = papers.select("paper_id", "title", F.posexplode("full_text").alias("sec_idx", "s"))
    paras = sections.select("paper_id", "title", "sec_idx", F.col("s.section_name").alias("section"), F.posexplode("s.paragraphs").alias("para_idx", "text"))
    kept = paras.where(~blank(F.col("text")) & (F.length("text") >= min_chars))
    ident = F.concat("paper_id", F.lit("__s"), F.col("sec_idx").cast("string"), F.lit("__p"), F.col("para_idx").cast("string"))
    return kept.select(ident.alias("chunk_id"), "paper_id", F.col("title").alias("paper_title"), (F.col("sec_idx").cast("long") * _STRIDE + F.col("para_idx")).alias("ordinal"), "section", "sec_idx", "text", F.lit("paragraph").alias("chunk_type"))


def line_chunks(docs: DataFrame) -> DataFrame:
    """Lines of documents as chunks, five to a section; blank lines leave a gap in the numbering."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kept = lines.where(~blank(F.col("text")))
    sec = F.floor(F.col("pos") / LINES_PER_SECTION).cast("int")
    ident = F.concat(F.col("doc_id").cast("string"), F.lit("__s"), sec.cast("string"), F.lit("__p"), F.col("pos").cast("string"))
    return kept.select(ident.alias("chunk_id"), F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id").cast("long") * _STRIDE + F.col("pos")).alias("ordinal"), sec.alias("sec_idx"), F.concat(F.lit("s"), sec.cast("string")).alias("section"), "text")


def filter_noise(chunks: DataFrame, qrels: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Chunks that are long enough or gold; adds is_gold."""
    gold = qrels.select("chunk_id").distinct().withColumn("is_gold", F.lit(True))
    out = chunks.join(gold, "chunk_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    return out.where((F.length("text") >= min_chars) | F.col("is_gold"))


def table_index_text(caption: Column, rows: Column) -> Column:
    """Caption and first-seen distinct cells, for a table's index."""
    cells = F.filter(F.transform(F.flatten(rows), squeeze), lambda c: c != "")
    return F.array_join(F.concat(F.filter(F.array(caption), lambda c: c.isNotNull() & (c != "")), F.array_distinct(cells)), " ")


def stamp(chunks: DataFrame, paper_id: Column, title: Column) -> DataFrame:
    """Ids made unique over papers: the paper's id goes before the chunk's, once; the original is kept."""
    pid = F.coalesce(F.col("paper_id"), paper_id)
    own = F.coalesce(F.col("original_chunk_id"), F.col("chunk_id"))
    prefix = F.concat(pid, F.lit("__"))
    return chunks.withColumns({"paper_id": pid, "paper_title": F.coalesce(F.col("paper_title"), title), "original_chunk_id": own, "chunk_id": F.when(F.col("chunk_id").startswith(prefix), F.col("chunk_id")).otherwise(F.concat(prefix, "chunk_id"))})


class _Merger:
    """Takes the paragraphs of a document in order and gives back those that are done."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, None

    def add(self, c: dict) -> list[dict]:
        done = []
        if c.get("chunk_type", "paragraph") == "paragraph" and self.held is not None and self.held["section"] == c["section"]:
            self.held = self.held | {"text": self.held["text"] + " " + c["text"]}
        else:
            done, self.held = self.rest(), c
        if self.held.get("chunk_type", "paragraph") != "paragraph" or len(self.held["text"]) >= self.limit:
            done += self.rest()
        return done

    def rest(self) -> list[dict]:
        done, self.held = [] if self.held is None else [self.held], None
        return done


def merge_rows(chunks: list[dict], limit: int = MERGE_CHARS) -> list[dict]:
    """Short paragraphs of one section joined until ``limit`` characters; tables stay alone and end a run."""
    m = _Merger(limit)
    return [x for c in chunks for x in m.add(c)] + m.rest()


def split_text(text: str, limit: int = MAX_CHARS) -> list[str]:
    """A text over the limit as runs of sentences, each beginning with the last sentence of the one before; sentences are never cut."""
    import re

    if len(text) <= limit:
        return [text]
    out, run, size = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if run and size + len(s) > limit:
            out.append(" ".join(run))
            run, size = [run[-1], s], len(run[-1]) + 1 + len(s)
        else:
            run.append(s)
            size += len(s) + 1
    return [x for x in [*out, " ".join(run)] if x]


def merge_short(chunks: DataFrame, key: str = "doc_id", limit: int = MERGE_CHARS) -> DataFrame:
    """``merge_rows`` within each document, in the order of ``ordinal``; a merged chunk has the first one's other columns.

    Documents come one after the other in sorted partitions, and only the paragraph that may grow is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at, schema = _Merger(limit), None, None
        for b in lots(batches):
            done, schema = [], b.schema
            for c in b.to_pylist():
                if c[key] != at:
                    done += m.rest()
                    at = c[key]
                done += m.add(c)
            yield pa.RecordBatch.from_pylist(done, schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(m.rest(), schema)

    return chunks.repartition(key).sortWithinPartitions(key, "ordinal").mapInArrow(run, chunks.schema)


def split_long(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """``split_text`` of each chunk; ``piece`` numbers the parts. Short chunks never leave the JVM."""
    wide = chunks.where(F.length("text") > limit)
    rest = chunks.where(F.coalesce(F.length("text") <= limit, F.lit(True))).withColumn("piece", F.lit(0))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches):
            parts = [split_text(t, limit) for t in b.column("text").to_pylist()]
            at = pa.array([i for i, ps in enumerate(parts) for _ in ps], pa.int64())
            made = {"text": pa.array([p for ps in parts for p in ps], b.schema.field("text").type), "piece": pa.array([n for ps in parts for n in range(len(ps))], pa.int32())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c).take(at) for c in names], names=names)

    return rest.unionByName(wide.mapInArrow(run, rest.schema))


def merged_table(ranked: DataFrame) -> DataFrame:
    """The two best tables of each query as one composite chunk (qid, chunk_id, text, caption, score, chunk_type)."""
    w = Window.partitionBy("qid").orderBy("rank")
    first = ranked.where(F.col("chunk_type").isin("table", "merged_tables")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    parts = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "chunk_id", "text", F.coalesce("caption", F.lit("")).alias("caption"), "score"))).alias("t")).where(F.size("t") == 2)
    return parts.select(
        "qid", F.array_join("t.chunk_id", "+").alias("chunk_id"), F.array_join("t.text", "\n\n---\n\n").alias("text"),
        F.array_join(F.filter("t.caption", lambda c: c != ""), " vs. ").alias("caption"), F.col("t")[0]["score"].alias("score"), F.lit("merged_tables").alias("chunk_type"),
    )


def preview(c: Column, limit: int = 280) -> Column:
    return F.substring(squeeze(c), 1, limit)


def context_block(ranked: DataFrame) -> DataFrame:
    """The retrieved chunks of each query as one numbered text."""
    line = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" | "), "chunk_id", F.lit("]\n"), "text")
    return ranked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def markdown_table(text: Column) -> Column:
    """Rows of cells of the pipe-table lines of a text, rule rows left out; the first is the header."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x.startswith("|") & F.substring(x, 2, 1 << 30).contains("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), strip))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?$")))


def normalized_table(columns: Column, rows: Column, text: Column, most: int = 20) -> Column:
    """struct(columns, rows): the structured form, or the text's pipe table; at most ``most`` rows."""
    solid = F.filter(rows, lambda r: F.exists(r, lambda c: ~blank(c)))
    clean = F.transform(solid, lambda r: F.transform(r, strip))
    ok = columns.isNotNull() & (F.coalesce(F.size(solid), F.lit(0)) > 0)
    parsed = markdown_table(text)
    empty = F.array().cast("array<string>")
    head = F.when(ok, F.transform(columns, strip)).otherwise(F.coalesce(F.get(parsed, F.lit(0)), empty))
    body = F.when(ok, clean).otherwise(F.coalesce(F.slice(parsed, 2, 1 << 30), F.array().cast("array<array<string>>")))
    return F.struct(head.alias("columns"), F.slice(body, 1, most).alias("rows"))
