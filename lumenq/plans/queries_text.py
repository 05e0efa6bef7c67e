"""Queries over chunks, tokens, BM25, vectors, fusion and postprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenq.functions.text import tokens
from lumenq.operators import bm25, chunking, dense, evaluate, fusion, postprocess, rerank, retrieve
from lumenq.plans import frames, sql
from lumenq.plans.registry import query


def _ranked(df, *more):
    return df.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *more)


_OUT = "SELECT qid, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score"


@query("chunk_lines", sql.cte(sql.LINES) + "SELECT chunk_id, doc_id, sec_idx, text FROM lines")
def chunk_lines(spark, d):
    return frames.lines(spark, d).select("chunk_id", "doc_id", "sec_idx", "text")


@query("chunk_filter_min80", sql.cte(sql.LINES) + "SELECT chunk_id, doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM lines WHERE length(text) >= 80")
def chunk_filter_min80(spark, d):
    return frames.lines(spark, d).where(F.length("text") >= chunking.MIN_CHARS).select("chunk_id", "doc_id", F.length("text").cast("long").alias("n_chars"))


_GOLD_LINES = r"gold AS (SELECT DISTINCT chunk_id FROM lines WHERE text IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark))"


@query("noise_filter_gold", sql.cte(sql.LINES, _GOLD_LINES) + "SELECT l.chunk_id, length(l.text) < 80 AS short, g.chunk_id IS NOT NULL AS is_gold FROM lines l LEFT JOIN gold g USING (chunk_id) WHERE length(l.text) >= 80 OR g.chunk_id IS NOT NULL")
def noise_filter_gold(spark, d):
    lines = frames.lines(spark, d)
    gold = frames.table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    return chunking.filter_noise(lines, lines.join(gold, "text", "left_semi")).select("chunk_id", (F.length("text") < 80).alias("short"), "is_gold")


@query("tokenize_counts", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({sql.toks('text')}) AS term FROM documents) GROUP BY term")
def tokenize_counts(spark, d):
    # counted within each document first, so that the distinct count needs no expansion
    per = frames.table(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("bm25_term_stats", sql.cte(sql.LINES, "none AS (SELECT 'x' AS qid, '' AS text)", sql.bm25("s", "lines", "none")) + "SELECT term, df, round(idf, 6) AS idf FROM s_stats")
def bm25_term_stats(spark, d):
    return bm25.term_stats(bm25.tokenized(frames.lines(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_top5", sql.cte(sql.LINES, sql.ITEMS, sql.bm25("s", "lines", "queries"), sql.completed("f", "s", "lines", "queries", 5), sql.top("t", "f", 5)) + _OUT + " FROM t")
def bm25_top5(spark, d):
    return _ranked(bm25.retrieve(frames.lines(spark, d), frames.items(spark, d), 5))


@query("bm25_paper_level", sql.cte(sql.DOCS, sql.ITEMS, sql.bm25("s", "chunks", "queries", distinct=True), sql.top("t", "s", 5)) + _OUT + " FROM t")
def bm25_paper_level(spark, d):
    return _ranked(bm25.top(bm25.best_sharing(frames.doc_chunks(spark, d), frames.items(spark, d), 5, distinct=True), 5))


@query(
    "bm25_per_source",
    sql.cte(sql.DOCS, "queries AS (SELECT CAST(item_id AS VARCHAR) || '@' || source AS qid, b.text, source FROM benchmark b, (SELECT DISTINCT source FROM documents))", sql.bm25("s", "chunks", "queries", scope="source"), sql.top("t", "s", 3))
    + _OUT + ", source FROM t",
)
def bm25_per_source(spark, d):
    docs, q = frames.doc_chunks(spark, d), frames.items(spark, d)
    each = q.crossJoin(docs.select("source").distinct()).select(F.concat("qid", F.lit("@"), "source").alias("qid"), "text", "source")
    return _ranked(bm25.top(bm25.best_sharing(docs, each, 3, ("source",)), 3), "source")


@query("dense_top5", sql.cte(sql.dense("s"), sql.top("t", "s", 5)) + _OUT + " FROM t")
def dense_top5(spark, d):
    return _ranked(dense.retrieve(frames.vectors(spark, d), frames.items_with_vectors(spark, d), 5))


def _both(k):
    return [sql.DOCS, "queries AS (SELECT CAST(item_id AS VARCHAR) AS qid, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)", sql.bm25("s", "chunks", "queries"), sql.completed("f", "s", "chunks", "queries", k), sql.top("bl", "f", k), sql.dense("ds"), sql.top("dl", "ds", k)]


def _rrf_sql(name, wb, wd, k, first="bl", second="dl"):
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, br NULLS LAST, dr NULLS LAST, ordinal) AS rank FROM (
  SELECT qid, chunk_id, min(ordinal) AS ordinal, sum(w / (60 + rank)) AS score, min(CASE WHEN l = 0 THEN rank END) AS br, min(CASE WHEN l = 1 THEN rank END) AS dr
  FROM (SELECT qid, chunk_id, ordinal, rank, 0 AS l, CAST({wb} AS DOUBLE) AS w FROM {first} UNION ALL SELECT qid, chunk_id, ordinal, rank, 1, CAST({wd} AS DOUBLE) FROM {second}) GROUP BY qid, chunk_id)) WHERE rank <= {k})"""


def _corpus(spark, d):
    return retrieve.Corpus(frames.doc_chunks(spark, d), frames.vectors(spark, d))


@query("rrf_fusion", sql.cte(*_both(100), _rrf_sql("r", 1, 1, 5)) + _OUT + " FROM r")
def rrf_fusion(spark, d):
    return _ranked(retrieve.by_rrf(_corpus(spark, d), frames.items_with_vectors(spark, d)))


@query("rrf_weighted", sql.cte(*_both(50), _rrf_sql("r", 1, 0.6, 50)) + _OUT + " FROM r")
def rrf_weighted(spark, d):
    c, q = _corpus(spark, d), frames.items_with_vectors(spark, d)
    return _ranked(fusion.rrf([(bm25.retrieve(c.chunks, q, 50), 1.0), (dense.retrieve(c.vectors, q, 50), 0.6)], 50))


_VARIANTS = """vs AS (SELECT qid || '#' || CAST(v AS VARCHAR) AS qid, qid AS q, v, text FROM (
  SELECT CAST(item_id AS VARCHAR) AS qid, 0 AS v, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
  UNION ALL SELECT CAST(item_id AS VARCHAR), 1, string_split(b.text, '.')[1] FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id))"""


@query(
    "multi_query_rrf",
    sql.cte(
        sql.DOCS, _VARIANTS, sql.bm25("s", "chunks", "vs"), sql.completed("f", "s", "chunks", "vs", 100), sql.top("bl", "f", 100), sql.dense("d0"),
        "ds AS (SELECT vs.qid, d0.chunk_id, d0.ordinal, d0.score FROM vs JOIN d0 ON d0.qid = vs.q)", sql.top("dl", "ds", 100), _rrf_sql("r", 1, 1, 100),
        """m AS (SELECT vs.q AS qid, chunk_id, min(ordinal) AS ordinal, sum((CASE WHEN v = 0 THEN 1.0 ELSE 0.7 END)::DOUBLE / (60 + rank)) AS score, min({'v': v, 'r': rank}) AS first FROM r JOIN vs ON vs.qid = r.qid GROUP BY vs.q, chunk_id)""",
    )
    + "SELECT qid, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, ordinal) AS rank FROM m) WHERE rank <= 5",
)
def multi_query_rrf(spark, d):
    q = frames.items_with_vectors(spark, d).withColumn("variants", F.array("text", F.split("text", r"\.")[0]))
    return _ranked(retrieve.by_multi_query(_corpus(spark, d), q))


@query(
    "ordered_union",
    sql.cte(*_both(10), "u AS (SELECT *, 0 AS l FROM bl UNION ALL SELECT *, 1 FROM dl)", "o AS (SELECT qid, chunk_id, min({'l': l, 'r': rank}) AS k FROM u GROUP BY qid, chunk_id)")
    + "SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY k) AS rank FROM o",
)
def ordered_union(spark, d):
    c, q = _corpus(spark, d), frames.items_with_vectors(spark, d)
    return fusion.ordered_union([bm25.retrieve(c.chunks, q, 10), dense.retrieve(c.vectors, q, 10)]).select("qid", "chunk_id", "rank")


_DOC_TOP = [sql.DOCS, sql.ITEMS, sql.bm25("s", "chunks", "queries"), sql.completed("f", "s", "chunks", "queries", 10), sql.top("t", "f", 10)]


def _doc_top(spark, d, k=10):
    return retrieve.with_chunks(bm25.retrieve(frames.doc_chunks(spark, d), frames.items(spark, d), k), frames.doc_chunks(spark, d))


@query(
    "section_cap",
    sql.cte(*_DOC_TOP, "c AS (SELECT t.qid, t.chunk_id, source, rank, row_number() OVER (PARTITION BY t.qid, source ORDER BY rank) AS n FROM t JOIN chunks USING (chunk_id))")
    + "SELECT qid, chunk_id, source AS section, row_number() OVER (PARTITION BY qid ORDER BY n > 2, rank) AS rank FROM c",
)
def section_cap(spark, d):
    return fusion.capped(_doc_top(spark, d), "section", postprocess.SECTION_CAP).select("qid", "chunk_id", "section", "rank")


@query(
    "doc_cap",
    sql.cte(sql.LINES, sql.ITEMS, sql.bm25("s", "lines", "queries"), sql.completed("f", "s", "lines", "queries", 10), sql.top("t", "f", 10), "c AS (SELECT t.qid, t.chunk_id, doc_id, rank, row_number() OVER (PARTITION BY t.qid, doc_id ORDER BY rank) AS n FROM t JOIN lines USING (chunk_id))")
    + "SELECT qid, chunk_id, doc_id, row_number() OVER (PARTITION BY qid ORDER BY n > 1, rank) AS rank FROM c",
)
def doc_cap(spark, d):
    lines = frames.lines(spark, d)
    top = bm25.retrieve(lines, frames.items(spark, d), 10)
    top = top.join(rerank.listed(lines, top).select("chunk_id", "doc_id"), "chunk_id")
    return fusion.capped(top, "doc_id", 1).select("qid", "chunk_id", "doc_id", "rank")


@query(
    "neighbor_window",
    sql.cte(sql.LINES, sql.ITEMS, sql.bm25("s", "lines", "queries"), sql.completed("f", "s", "lines", "queries", 3), sql.top("t", "f", 3), "p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS place FROM lines)")
    + """SELECT t.qid, a.chunk_id AS anchor_id, b.chunk_id, CAST(abs(b.place - a.place) AS BIGINT) AS distance, round(t.score - 0.01 * abs(b.place - a.place), 6) AS score
FROM t JOIN p a USING (chunk_id) JOIN p b ON a.doc_id = b.doc_id AND b.place BETWEEN a.place - 2 AND a.place + 2 AND b.place <> a.place""",
)
def neighbor_window(spark, d):
    lines = frames.lines(spark, d)
    out = fusion.neighbours(bm25.retrieve(lines, frames.items(spark, d), 3), lines, 2)
    return out.select("qid", "anchor_id", "chunk_id", F.col("distance").cast("long").alias("distance"), F.round("score", 6).alias("score"))


def _plans(spark, d):
    """Plans that differ by item: numerical, comparison and factual in turn."""
    kind = F.element_at(F.array(F.lit("numerical"), F.lit("comparison"), F.lit("factual")), (F.col("item_id") % 3 + 1).cast("int"))
    return frames.items(spark, d).select("qid", kind.alias("query_type"), F.lit(False).alias("cross_table"), F.lit(False).alias("is_yes_no"))


_PLANS = "plans AS (SELECT CAST(item_id AS VARCHAR) AS qid, ['numerical', 'comparison', 'factual'][item_id % 3 + 1] AS query_type FROM benchmark)"
_TABLES = ["tchunks AS (SELECT * FROM chunks WHERE contains(text, '|'))", sql.bm25("ts", "tchunks", "queries"), sql.completed("tf", "ts", "tchunks", "queries", 2), sql.top("tt", "tf", 2)]


@query(
    "table_injection",
    sql.cte(
        *_DOC_TOP, _PLANS, *_TABLES, "cut AS (SELECT t.qid, chunk_id, rank, query_type, contains(text, '|') AS tab FROM t JOIN chunks USING (chunk_id) JOIN plans USING (qid) WHERE rank <= 5)",
        "wants AS (SELECT qid, any_value(query_type) AS query_type FROM cut GROUP BY qid HAVING NOT bool_or(tab) AND any_value(query_type) <> 'factual')",
        "best AS (SELECT tt.qid, tt.chunk_id FROM tt JOIN wants USING (qid) WHERE rank = 1 AND (query_type = 'numerical' OR score > 0))",
        "u AS (SELECT qid, chunk_id, rank FROM cut WHERE qid NOT IN (SELECT qid FROM best) OR rank <= 4 UNION ALL SELECT qid, chunk_id, 0 FROM best)",
    )
    + "SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM u",
)
def table_injection(spark, d):
    chunks, q = frames.doc_chunks(spark, d), frames.items(spark, d)
    return postprocess.with_table(_doc_top(spark, d), retrieve.tables_by_bm25(chunks, q), _plans(spark, d), 5).select("qid", "chunk_id", "rank")


@query(
    "low_confidence_flag",
    sql.cte(
        *_DOC_TOP, _PLANS,
        r"x AS (SELECT t.qid, t.chunk_id, rank, score, query_type, bool_or(regexp_matches(text, '(?:^|[^A-Za-z])-?[0-9]')) OVER w AS nums, count(*) OVER w AS n FROM t JOIN chunks USING (chunk_id) JOIN plans USING (qid) WINDOW w AS (PARTITION BY t.qid))",
    )
    + "SELECT qid, chunk_id, score < 0 OR (query_type = 'numerical' AND NOT nums) OR (query_type = 'comparison' AND n < 2) AS low_confidence FROM x WHERE rank = 1",
)
def low_confidence_flag(spark, d):
    return postprocess.with_confidence(_doc_top(spark, d), _plans(spark, d)).where("rank = 1").select("qid", "chunk_id", "low_confidence")


_STOP = ", ".join(f"'{w}'" for w in retrieve.ANCHOR_STOP)


@query(
    "paper_score_two_stage",
    sql.cte(
        sql.LINES, sql.ITEMS, sql.bm25("s", "lines", "queries"), "papers AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS ordinal, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[1] || ' ' || substring(text, 1, 500) AS text FROM documents)",
        sql.bm25("o", "papers", "queries", distinct=True), "best AS (SELECT s.qid, CAST(doc_id AS VARCHAR) AS pid, greatest(max(score), 0) AS best FROM s JOIN lines USING (chunk_id) GROUP BY ALL)",
        "j AS (SELECT coalesce(b.qid, o.qid) AS qid, coalesce(b.pid, o.chunk_id) AS pid, coalesce(best, 0) AS b, coalesce(o.score, 0) AS p FROM best b FULL JOIN o ON b.qid = o.qid AND b.pid = o.chunk_id)",
        f"a AS (SELECT j.*, papers.ordinal, list_filter(list_distinct({sql.toks('q.text')}), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})) AS anchors, {sql.toks('title')} AS tt, {sql.toks('papers.text')} AS ta FROM j JOIN queries q USING (qid) JOIN papers ON papers.chunk_id = j.pid)",
        "v AS (SELECT qid, pid, ordinal, CASE WHEN len(anchors) > 0 THEN (0.25 * b + 2 * p + CASE WHEN list_has_any(anchors, tt) THEN p ELSE 0 END) * CASE WHEN list_has_any(anchors, ta) THEN 1 ELSE 0.1 END ELSE b + p END AS score FROM a)", sql.top("t", "v", 8),
    )
    + "SELECT qid, pid AS paper_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM t",
)
def paper_score_two_stage(spark, d):
    lines = frames.lines(spark, d).withColumn("paper_id", F.col("doc_id").cast("string"))
    papers = frames.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("doc_id").alias("ordinal"), F.split("text", "\n")[0].alias("title"), F.substring("text", 1, 500).alias("abstract"))
    q = frames.items(spark, d)
    out = retrieve.best_papers(bm25.Index(lines), papers, q)
    return out.select("qid", "paper_id", "rank", F.round("score", 6).alias("score"))


@query(
    "rerank_pairs",
    sql.cte(
        *_DOC_TOP[:3], sql.completed("f", "s", "chunks", "queries", 50), sql.top("t", "f", 50),
        f"p AS (SELECT t.qid, t.chunk_id, rank AS was, list_distinct({sql.toks('q.text')}) AS a, list_distinct({sql.toks('c.text')}) AS b FROM t JOIN queries q USING (qid) JOIN chunks c USING (chunk_id))",
        "r AS (SELECT qid, chunk_id, was, 4.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) - 1 AS score FROM p)",
    )
    + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank FROM r) WHERE rank <= 5",
)
def rerank_pairs(spark, d):
    return _ranked(retrieve.by_pair(_corpus(spark, d), frames.items(spark, d)))


_SPACE = r"[\s\x{85}\p{Z}]"


@query(
    "markdown_tables",
    rf"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x LIKE '|%|%') AS ls FROM documents WHERE contains(text, '|')),
r AS (SELECT doc_id, source, list_filter(list_transform(ls, lambda x: list_transform(string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^{_SPACE}+|{_SPACE}+$', '', 'g'))), lambda c: len(list_filter(c, lambda v: NOT regexp_matches(v, '^:?-{{3,}}:?$'))) > 0) AS rs FROM l)
SELECT doc_id, coalesce(array_to_string(rs[1], ' / '), '') AS header, CAST(least(20, greatest(0, len(rs) - 1)) AS INTEGER) AS n_rows, array_to_string(list_concat(CASE WHEN source <> '' THEN [source] ELSE [] END, list_filter(flatten(rs[2:21]), lambda c: c <> '')), ' ') AS all_cells FROM r""",
)
def markdown_tables(spark, d):
    """Pipe tables in documents, with the text that indexes them but for repeated cells."""
    t = frames.table(spark, d, "documents").where(F.col("text").contains("|"))
    none = F.lit(None)
    n = t.select("doc_id", "source", chunking.normalized_table(none.cast("array<string>"), none.cast("array<array<string>>"), F.col("text")).alias("t"))
    cells = F.filter(F.flatten("t.rows"), lambda c: c != "")
    return n.select("doc_id", F.array_join("t.columns", " / ").alias("header"), F.size("t.rows").alias("n_rows"), F.array_join(F.concat(F.filter(F.array("source"), lambda x: x != ""), cells), " ").alias("all_cells"))


@query("chunk_previews", sql.cte(sql.DOCS) + rf"SELECT source || '__' || chunk_id AS chunk_id, chunk_id AS original_chunk_id, source AS paper_id, substring(regexp_replace(regexp_replace(text, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), 1, 280) AS preview FROM chunks")
def chunk_previews(spark, d):
    """Documents stamped with their source as paper, and the first characters of each."""
    rows = frames.doc_chunks(spark, d).withColumns({"original_chunk_id": F.lit(None).cast("string"), "paper_id": F.col("source"), "paper_title": F.lit(None).cast("string")})
    return chunking.stamp(rows, F.lit("x"), F.lit("T")).select("chunk_id", "original_chunk_id", "paper_id", chunking.preview(F.col("text")).alias("preview"))


@query(
    "merge_short_chunks",
    "WITH RECURSIVE " + sql.LINES + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS place FROM lines),
run AS (SELECT doc_id, place, chunk_id, section, text, length(text) >= {chunking.MERGE_CHARS} AS closed, FALSE AS joined FROM p WHERE place = 1
  UNION ALL
  SELECT p.doc_id, p.place, CASE WHEN NOT r.closed AND r.section = p.section THEN r.chunk_id ELSE p.chunk_id END, p.section,
         CASE WHEN NOT r.closed AND r.section = p.section THEN r.text || ' ' || p.text ELSE p.text END,
         length(CASE WHEN NOT r.closed AND r.section = p.section THEN r.text || ' ' || p.text ELSE p.text END) >= {chunking.MERGE_CHARS}, NOT r.closed AND r.section = p.section
  FROM run r JOIN p ON p.doc_id = r.doc_id AND p.place = r.place + 1)
SELECT chunk_id, doc_id, section, CAST(max(length(text)) AS INTEGER) AS n_chars FROM run GROUP BY chunk_id, doc_id, section""",
)
def merge_short_chunks(spark, d):
    rows = frames.lines(spark, d).withColumn("chunk_type", F.lit("paragraph"))
    return chunking.merge_short(rows).select("chunk_id", "doc_id", "section", F.length("text").alias("n_chars"))


@query(
    "split_long_chunks",
    "WITH RECURSIVE " + sql.DOCS + rf""",
l AS (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM chunks WHERE length(text) > {chunking.MAX_CHARS}),
g AS (SELECT chunk_id, ps, 1 AS k, CAST(0 AS INTEGER) AS piece, [ps[1]] AS run, length(ps[1]) + 1 AS size, NULL::VARCHAR AS done FROM l
  UNION ALL
  SELECT chunk_id, ps, k + 1, CASE WHEN size + length(ps[k + 1]) > {chunking.MAX_CHARS} THEN piece + 1 ELSE piece END,
         CASE WHEN size + length(ps[k + 1]) > {chunking.MAX_CHARS} THEN [run[-1], ps[k + 1]] ELSE list_append(run, ps[k + 1]) END,
         CASE WHEN size + length(ps[k + 1]) > {chunking.MAX_CHARS} THEN length(run[-1]) + 1 ELSE size + 1 END + length(ps[k + 1]),
         CASE WHEN size + length(ps[k + 1]) > {chunking.MAX_CHARS} THEN array_to_string(run, ' ') END
  FROM g WHERE k < len(ps)),
o AS (SELECT chunk_id, piece - 1 AS piece, done AS text FROM g WHERE done IS NOT NULL UNION ALL SELECT chunk_id, piece, array_to_string(run, ' ') FROM g WHERE k = len(ps))
SELECT chunk_id, CAST(piece AS INTEGER) AS piece, CAST(length(text) AS INTEGER) AS n_chars FROM o WHERE text <> '' UNION ALL SELECT chunk_id, 0, CAST(length(text) AS INTEGER) FROM chunks WHERE text IS NULL OR length(text) <= {chunking.MAX_CHARS}""",
)
def split_long_chunks(spark, d):
    return chunking.split_long(frames.doc_chunks(spark, d)).select("chunk_id", "piece", F.length("text").alias("n_chars"))


@query("ann_top5")
def ann_top5(spark, d):
    return _ranked(dense.retrieve_hashed(frames.vectors(spark, d), frames.items_with_vectors(spark, d), 5))


_PAIR = f"CASE WHEN len(list_distinct({sql.toks('q.text')})) + len(list_distinct({sql.toks('c.text')})) > 0 THEN 4.0::DOUBLE * len(list_intersect(list_distinct({sql.toks('q.text')}), list_distinct({sql.toks('c.text')}))) / (len(list_distinct({sql.toks('q.text')})) + len(list_distinct({sql.toks('c.text')}))) - 1 ELSE -1 END"


def _pairs_sql(name, pool, k=5):
    """``pool`` (qid, chunk_id, rank) reranked by token overlap."""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank FROM (SELECT p.qid, p.chunk_id, p.rank AS was, {_PAIR} AS score FROM {pool} p JOIN queries q USING (qid) JOIN chunks c USING (chunk_id))) WHERE rank <= {k})"


def _lists_sql(**lists):
    return " UNION ALL ".join(f"{_OUT}, '{name}' AS strategy FROM {rows} WHERE rank <= 5" for name, rows in lists.items())


@query(
    "within_source_strategies",
    sql.cte(
        sql.DOCS, "papers AS (SELECT source, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM chunks))",
        "queries AS (SELECT CAST(item_id AS VARCHAR) AS qid, b.text, p.source FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN papers p ON p.n = b.item_id % 20 + 1)",
        sql.bm25("s", "chunks", "queries", "source"), "own AS (SELECT q.qid, c.chunk_id, c.ordinal FROM queries q JOIN chunks c USING (source))",
        "lx AS (SELECT own.qid, own.chunk_id, own.ordinal, coalesce(s.score, 0) AS score FROM own LEFT JOIN s ON s.qid = own.qid AND s.chunk_id = own.chunk_id)", sql.top("bl", "lx", 1 << 30), sql.dense("ds"),
        "sx AS (SELECT own.qid, own.chunk_id, own.ordinal, ds.score FROM own JOIN ds ON ds.qid = own.qid AND ds.chunk_id = own.chunk_id)", sql.top("dl", "sx", 1 << 30), _rrf_sql("r", 1, 1, 1 << 30), "pool AS (SELECT * FROM r WHERE rank <= 50)", _pairs_sql("ce", "pool"),
    )
    + _lists_sql(BM25="bl", Dense="dl", RRF="r", CE="ce"),
)
def within_source_strategies(spark, d):
    chunks = frames.doc_chunks(spark, d).withColumn("paper_id", F.col("source"))
    first = chunks.groupBy("paper_id").agg(F.min("ordinal").alias("o"))
    q = frames.items_with_vectors(spark, d).join(first.select("paper_id", F.row_number().over(_by("paper_id")).alias("n")), F.col("item_id") % 20 + 1 == F.col("n")).drop("n")
    out = None
    for name, rows in retrieve.within_paper(retrieve.Corpus(chunks, frames.vectors(spark, d)), q).items():
        rows = _ranked(rows).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _by(column):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over one row for each source


@query("library_search")
def library_search(spark, d):
    lines = frames.lines(spark, d).withColumns({"paper_id": F.col("doc_id").cast("string"), "chunk_type": F.when(F.col("text").contains("|"), "table").otherwise("paragraph"), "caption": F.lit(None).cast("string")})
    papers = frames.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("doc_id").alias("ordinal"), F.split("text", "\n")[0].alias("title"), F.substring("text", 1, 500).alias("abstract"))
    q = frames.items_with_vectors(spark, d)
    vecs = frames.vectors(spark, d).withColumn("chunk_id", F.concat("chunk_id", F.lit("__s0__p0")))
    return retrieve.library_search(retrieve.Corpus(lines, vecs), papers, q, _plans(spark, d)).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"), "score_kind", "low_confidence")


@query("qrels_fuzzy")
def qrels_fuzzy(spark, d):
    """Benchmark lines aligned to document lines of the source that its number picks; the key keeps pairs within a paper."""
    lines = frames.lines(spark, d).withColumn("paper_id", F.pmod("doc_id", F.lit(40)).cast("string"))
    proof = frames.items(spark, d).select("qid", F.pmod("item_id", F.lit(40)).cast("string").alias("paper_id"), F.explode(F.split("text", "\n")).alias("evidence"))
    return evaluate.fuzzy_qrels(proof, lines.where(F.length("text") >= chunking.MIN_CHARS))


@query(
    "rerank_from_model",
    sql.cte(
        *_DOC_TOP[:3], sql.completed("f", "s", "chunks", "queries", 50), sql.top("t", "f", 50),
        "r AS (SELECT t.qid, t.chunk_id, rank AS was, -abs(length(q.text) - length(c.text))::DOUBLE / (length(q.text) + length(c.text) + 1) AS score FROM t JOIN queries q USING (qid) JOIN chunks c USING (chunk_id))",
    )
    + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank FROM r) WHERE rank <= 5",
)
def rerank_from_model(spark, d):
    """A Python pair scorer in place of the built-in one, over the pool of fifty."""
    c = _corpus(spark, d)
    c.scorer = rerank.from_model(lambda pairs: [-abs(len(a) - len(b)) / (len(a) + len(b) + 1) for a, b in pairs])
    return _ranked(retrieve.by_pair(c, frames.items(spark, d)))
