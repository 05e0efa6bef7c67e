"""Gold alignment, retrieval metrics and their breakdowns, samples and baselines."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions import blocks
from lumenq.functions.text import tokens
from lumenq.operators import matrix

ALIGN, MIN_QA, PER_TYPE, PARTIAL_POOL = 0.4, 2, 10, 20
METRICS = ["hit1", "hit3", "hit5", "ndcg5", "evidence_recall5", "all_evidence_recall5", "mrr"]


def papers_with_questions(papers: DataFrame, least: int = MIN_QA) -> DataFrame:
    """Papers with at least ``least`` questions whose first answer isn't marked unanswerable."""
    return papers.where(F.size(F.filter("qas", lambda q: ~F.coalesce(F.get(q["answers"], F.lit(0))["answer"]["unanswerable"], F.lit(False)) & (F.size(q["answers"]) > 0))) >= least)


def _answer_text(a: Column) -> Column:
    """yes or no, else the extractive spans, else the free form as it is."""
    spans = F.coalesce(a["extractive_spans"], F.array().cast("array<string>"))
    return F.when(a["yes_no"].isNotNull(), F.when(a["yes_no"], "yes").otherwise("no")).when(F.size(spans) > 0, F.array_join(spans, "; ")).otherwise(F.coalesce(a["free_form_answer"], F.lit("")))


def answer_type(a: Column) -> Column:
    return F.when(a["yes_no"].isNotNull(), "yes_no").when(F.coalesce(F.size(a["extractive_spans"]), F.lit(0)) > 0, "extractive").when(F.coalesce(a["free_form_answer"], F.lit("")) != "", "free_form").otherwise("unknown")


def _given(answers: Column) -> Column:
    """The annotators' answers but the missing and the unanswerable ones."""
    return F.filter(F.transform(answers, lambda x: x["answer"]), lambda a: a.isNotNull() & ~F.coalesce(a["unanswerable"], F.lit(False)))


def _evidence(given: Column) -> Column:
    all_of = F.flatten(F.transform(given, lambda a: F.coalesce(a["evidence"], F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(all_of, lambda e: e.isNotNull()))


def answerable_queries(papers: DataFrame) -> DataFrame:
    """One row for each question that some annotator answers: evidence of all of them, ordered and distinct, without figures; up to three distinct answers; the first one's type."""
    rows = papers.select("paper_id", F.explode("qas").alias("q")).select("paper_id", "q.*").withColumn("given", _given(F.col("answers"))).where(F.size("given") > 0)
    proof = F.filter(_evidence(F.col("given")), lambda e: ~e.startswith("FLOAT SELECTED"))
    answers = F.slice(F.array_distinct(F.filter(F.transform("given", _answer_text), lambda t: t != "")), 1, 3)
    kind = answer_type(F.get("given", F.lit(0)))
    out = rows.select(F.concat("paper_id", F.lit("__"), "question_id").alias("qid"), "paper_id", "question", proof.alias("evidence"), F.array_join(answers, " | ").alias("reference_answer"), kind.alias("answer_type"), "nlp_background", "topic_background")
    return out.where(F.size("evidence") > 0)


def annotated_questions(papers: DataFrame) -> DataFrame:
    """Every question of every paper, answered or not: its answer types and form labels (sorted, distinct), how many found it unanswerable, up to five reference answers, all evidence."""
    empty = F.array().cast("array<string>")
    rows = papers.select("paper_id", F.explode("qas").alias("q")).select("paper_id", "q.*").withColumn("records", F.filter(F.transform(F.coalesce("answers", F.array().cast(papers.schema["qas"].dataType.elementType["answers"].dataType)), lambda x: x["answer"]), lambda a: a.isNotNull()))
    given = F.filter("records", lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)))
    form = F.transform("records", lambda a: F.when(F.coalesce(a["unanswerable"], F.lit(False)), "unanswerable").when(a["yes_no"].isNotNull(), _answer_text(a)).otherwise(answer_type(a)))
    parts = F.flatten(F.transform(given, lambda a: F.when(answer_type(a) == "extractive", F.coalesce(a["extractive_spans"], empty)).when(answer_type(a) == "unknown", empty).otherwise(F.array(_answer_text(a)))))
    return rows.select(
        F.concat("paper_id", F.lit("__"), "question_id").alias("qid"), "paper_id", F.coalesce("question", F.lit("")).alias("question"), F.array_sort(F.array_distinct(F.transform(given, answer_type))).alias("answer_types"), F.array_sort(F.array_distinct(form)).alias("answer_form_labels"),
        (F.size(given) > 0).alias("has_answer"), (F.size("records") - F.size(given)).alias("unanswerable_count"), F.array_join(F.slice(parts, 1, 5), " | ").alias("reference_answer"), _evidence(given).alias("evidence"), "nlp_background", "topic_background",
    )


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of the whole texts; nulls are empty."""
    (x, xs), (y, ys) = blocks.codes(a.fillna("").tolist()), blocks.codes(b.fillna("").tolist())
    return pd.Series(blocks.ratios(x, xs[:-1], np.diff(xs), y, ys[:-1], np.diff(ys)), dtype="float64")


#: Evidence texts, and characters of them, that are broadcast at most; more are joined. Bytes of chunks that are compared at once.
MAX_EVIDENCE, MAX_EVIDENCE_CHARS, LOT = 100_000, 1 << 25, 1 << 23


def fuzzy_qrels(evidence: DataFrame, chunks: DataFrame, key: str = "paper_id", least: float = ALIGN) -> DataFrame:
    """(qid, chunk_id): for each evidence text (qid, key, evidence) the most similar chunk of its paper, if similar enough; the first of equals.

    Whole texts are compared, and all of their characters count. The evidence is collected up to a size and broadcast, so
    that chunks are compared where they lie; each task hands on the best chunk of each evidence text alone.
    """
    given = evidence.where(F.col("evidence").isNotNull() & F.col(key).isNotNull()).select("qid", F.col(key).cast("string").alias("_key"), "evidence").distinct()
    asked = given.limit(MAX_EVIDENCE + 1).collect()
    rows = chunks.where(F.col("text").isNotNull()).select(F.col(key).cast("string").alias("_key"), "chunk_id", "ordinal", "text")
    if len(asked) > MAX_EVIDENCE or sum(len(r.evidence) for r in asked) > MAX_EVIDENCE_CHARS:
        # the ratio is at most twice the shorter length over both, so pairs that can't reach the threshold skip the UDF
        a, b = F.length("evidence"), F.length("text")
        found = given.join(rows, "_key").where(2 * F.least(a, b) >= least * (a + b)).select("qid", "evidence", "chunk_id", "ordinal", similarity("evidence", "text").alias("s"))
    else:
        numbers = {pair: i for i, pair in enumerate(sorted({(r["_key"], r.evidence) for r in asked}))}
        own = given.sparkSession.createDataFrame([(numbers[r["_key"], r.evidence], r.qid, r.evidence) for r in asked], T.StructType([T.StructField("no", T.LongType()), given.schema["qid"], T.StructField("evidence", T.StringType())]))
        found = _most_similar(matrix.spread(rows), list(numbers), least).join(own, "no")
    best = found.where(F.col("s") >= least).withColumn("_n", F.row_number().over(Window.partitionBy("qid", "evidence").orderBy(F.col("s").desc(), "ordinal"))).where(F.col("_n") == 1)
    return best.select("qid", "chunk_id").distinct()


def _most_similar(chunks: DataFrame, asked: list[tuple[str, str]], least: float) -> DataFrame:
    """(no, chunk_id, ordinal, s): the best chunks of each (key, text) of ``asked``, by its number, in each lot of chunks (_key, chunk_id, ordinal, text)."""
    shared = chunks.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("no", T.LongType()), chunks.schema["chunk_id"], chunks.schema["ordinal"], T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, starts = blocks.codes([t for _, t in shared.value])
        na, top = np.diff(starts), np.full(len(shared.value), float(least))
        of_key: dict[str, list[int]] = {}
        for no, (k, _) in enumerate(shared.value):
            of_key.setdefault(k, []).append(no)

        def compared(lot: pa.Table) -> pa.RecordBatch:
            b, at = blocks.codes(lot["text"].to_pylist())
            nb, keys, ordinals = np.diff(at), lot["_key"].combine_chunks().dictionary_encode(), lot["ordinal"].to_numpy()
            code = pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
            out, held = [], []

            def flush() -> None:
                i, j = np.concatenate([np.full(len(x), no) for no, x in held]), np.concatenate([x for _, x in held])
                held.clear()
                s = blocks.ratios(a, starts[i], na[i], b, at[j], nb[j], top[i])
                some = np.flatnonzero(s >= 0)
                some = some[np.lexsort((ordinals[j[some]], -s[some], i[some]))]
                some = some[np.unique(i[some], return_index=True)[1]]
                top[i[some]] = s[some]
                out.append((i[some], j[some], s[some]))

            for c, k in enumerate(keys.dictionary.to_pylist()):
                mine = np.flatnonzero(code == c) if k in of_key else []
                for no in of_key[k] if len(mine) else []:
                    # the ratio is at most twice the shorter length over both
                    held.append((no, mine[2 * np.minimum(na[no], nb[mine]) >= top[no] * (na[no] + nb[mine])]))
                    if sum(len(x) for _, x in held) >= blocks.PAIRS:
                        flush()
            if held:
                flush()
            i, j, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            took = lot.select(["chunk_id", "ordinal"]).take(pa.array(j))
            return pa.Table.from_arrays([pa.array(i), took["chunk_id"], took["ordinal"], pa.array(s)], names=schema.names)

        for lot in _lots(batches, LOT):
            yield from compared(lot).to_batches()

    return chunks.mapInArrow(run, schema)


def _lots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together or cut into tables of about ``size`` bytes."""
    held, held_bytes = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            held.append(part)
            held_bytes += part.nbytes
            if held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Questions, and characters of them, that are sought in one automaton; more are matched by keys.
MAX_PATTERNS, MAX_PATTERN_CHARS = 200_000, 1 << 25


def exact_qrels(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, chunk_id) of the documents that hold a question's text verbatim; an empty text is in every one.

    The questions are collected up to a size and sought together in one pass over each batch of documents, without a shuffle of these.
    """
    asked = queries.where(F.col("text").isNotNull()).select(F.col("qid").cast("string").alias("qid"), "text").limit(MAX_PATTERNS + 1).collect()
    if len(asked) > MAX_PATTERNS or sum(len(r.text) for r in asked) > MAX_PATTERN_CHARS:
        return _qrels_by_keys(queries, docs)
    by_text: dict[str, list[str]] = {}
    for r in asked:
        by_text.setdefault(r.text, []).append(r.qid)
    shared = docs.sparkSession.sparkContext.broadcast(by_text)
    schema = T.StructType([T.StructField("qid", T.StringType()), docs.schema["chunk_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        everywhere, sought = shared.value.get("", []), ahocorasick.Automaton()
        for text, qids in shared.value.items():
            if text:
                sought.add_word(text, qids)
        if len(sought):
            sought.make_automaton()
        for b in batches:
            qids, at = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if text is None:
                    continue
                hits = {id(v): v for _, v in sought.iter(text)} if len(sought) else {}
                own = [*everywhere, *(q for v in hits.values() for q in v)]
                qids += own
                at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.string()), b.column("chunk_id").take(pa.array(at, pa.int64()))], names=["qid", "chunk_id"])

    return docs.select("chunk_id", "text").mapInArrow(run, schema).distinct()


def _qrels_by_keys(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, chunk_id) of the documents that hold a question's text verbatim.

    Texts are matched by their first six tokens before the strings are compared, so the join is by key and not by every pair.
    """
    def run(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("t", i, n), " "))

    n = 6
    asked = queries.select("qid", F.col("text").alias("q"), tokens(F.col("text")).alias("t"))
    # the first token may be cut by the place where the text begins, so keys start at the second
    long = asked.where(F.size("t") > n + 1).withColumn("key", F.array_join(F.slice("t", 2, n), " "))
    short = asked.where(F.size("t") <= n + 1)
    held = docs.select("chunk_id", "text", tokens(F.col("text")).alias("t"))
    keys = long.select("key").distinct()
    lines = held.select("chunk_id", "text", F.explode(F.array_distinct(run(n))).alias("key")).join(keys, "key", "left_semi")
    met = lines.join(long.select("qid", "q", "key"), "key").where(F.col("text").contains(F.col("q"))).select("qid", "chunk_id")
    return met.unionByName(held.join(short.select("qid", "q"), F.col("text").contains(F.col("q"))).select("qid", "chunk_id")).distinct()


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 5, section: str | None = None) -> DataFrame:
    """Metrics of each question that has gold; questions whose list is empty are there with zeros."""
    gold = qrels.select("qid", "chunk_id").distinct().withColumn("gold", F.lit(1))
    n_gold = gold.groupBy("qid").agg(F.count("*").alias("gold_count"))
    hits = ranked.join(gold, ["qid", "chunk_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    within = F.col("rank") <= k
    parts = [
        *[F.max(F.when(F.col("rank") <= n, F.col("gold")).otherwise(0)).cast("double").alias(f"hit{n}") for n in (1, 3, 5)],
        F.sum(F.when(within & (F.col("gold") == 1), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(within, F.col("gold")).otherwise(0)).alias("found"), F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first_gold_rank"),
    ]
    if section:
        parts += [F.count_distinct(F.when(within, F.col(section))).alias("_sections"), F.count(F.when(within, F.lit(1))).alias("_rows")]
    each = n_gold.join(hits.groupBy("qid").agg(*parts), "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold_count"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    out = [
        "qid", "gold_count", *[F.coalesce(f"hit{n}", F.lit(0.0)).alias(f"hit{n}") for n in (1, 3, 5)], F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg5"), F.coalesce(F.col("found") / F.col("gold_count"), F.lit(0.0)).alias("evidence_recall5"),
        F.coalesce((F.col("found") == F.col("gold_count")).cast("double"), F.lit(0.0)).alias("all_evidence_recall5"), F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0)).alias("mrr"), F.col("first_gold_rank").cast("long").alias("first_gold_rank"),
    ]
    if section:
        out.append(F.when(F.coalesce("_rows", F.lit(0)) == 0, 0.0).otherwise(1.0 - F.col("_sections") / F.col("_rows")).alias("section_redundancy"))
    return each.select(*out)


def summary(each: DataFrame, *by: str) -> DataFrame:
    """Means of all questions; mean and median rank over those with a hit."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], F.round(F.avg("first_gold_rank"), 6).alias("mean_gold_rank"), F.round(F.median("first_gold_rank"), 6).alias("median_gold_rank")]
    return each.groupBy(*by).agg(*aggs)


def breakdown(each: DataFrame, *by: str) -> DataFrame:
    """Means by each of several columns and over all, in one pass; nulls are "unknown"."""
    rows = each
    for c in by:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    out = rows.groupingSets([[F.col(c)] for c in by] + [[]], *[F.col(c) for c in by]).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], *[F.grouping(c).alias(f"_g_{c}") for c in by])
    dimension, value = F.lit("all"), F.lit("all")
    for c in by:
        dimension, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", *METRICS)


def evidence_group(gold_count: Column) -> Column:
    return F.when(gold_count == 1, "single").otherwise("multi")


def stratified(rows: DataFrame, by: str, n: int = PER_TYPE, seed: int = 42, key: str = "qid") -> DataFrame:
    """Exactly n rows of each value, or all: those whose hash with the seed comes first."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return rows.withColumn("sample_no", F.row_number().over(Window.partitionBy(by).orderBy(order, key)).cast("long")).where(F.col("sample_no") <= n)


def random_ndcg(n_chunks: Column, n_gold: Column, k: int = 5) -> Column:
    """Expected NDCG@k of a random order: every place holds gold with probability gold / chunks."""
    def gains(m: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))

    return F.when((n_chunks <= 0) | (n_gold <= 0), 0.0).otherwise(n_gold / n_chunks * gains(n_chunks) / gains(n_gold))


def insufficient_cases(each: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """For questions without a hit in the top 5, the first chunk that came instead and whether it is of the gold's paper (ids are paper__rest)."""
    missed = each.where("hit5 = 0").select("qid")
    gold = qrels.groupBy("qid").agg(F.min(F.split("chunk_id", "__")[0]).alias("gold_paper"))
    got = ranked.where("rank = 1").select("qid", F.col("chunk_id").alias("top_chunk"), F.split("chunk_id", "__")[0].alias("top_paper"))
    both = missed.join(gold, "qid").join(got, "qid", "left")
    return both.withColumn("where", F.when(F.col("gold_paper") == F.col("top_paper"), "same-paper").otherwise("diff-paper"))


def agent_results(results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Agent runs (qid, retrieved_ids, latency_ms and what else they have) with the metrics of their lists; questions without gold go, rows without an id are skipped before ranks are given."""
    ids = F.filter("retrieved_ids", lambda x: x.isNotNull() & (x != ""))
    ranked = results.select("qid", F.posexplode(ids).alias("p", "chunk_id")).select("qid", "chunk_id", (F.col("p") + 1).alias("rank"))
    gold = qrels.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_ids"))
    return results.withColumn("retrieved_ids", ids).join(gold, "qid").join(per_query(ranked, qrels, k).drop("gold_count"), "qid")


def agent_summary(each: DataFrame, name: str = "agent") -> DataFrame:
    """One row: the means of the metrics and of the latency, zeros where there is no run."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in (*METRICS, "latency_ms")]
    return each.agg(F.count("*").alias("n"), *means).withColumn("name", F.lit(name))


def timed(ranked: DataFrame, n_queries: int) -> tuple[DataFrame, float]:
    """The list, kept, and the milliseconds that it took a question: questions are answered together, so it is their mean."""
    began = time.perf_counter()
    kept = ranked.persist()
    kept.count()
    return kept, 1000 * (time.perf_counter() - began) / max(1, n_queries)


def random_lift(each: DataFrame, pools: DataFrame, k: int = 5) -> DataFrame:
    """One row: the mean NDCG of questions (qid, gold_count, ndcg5), that of a random order of each one's pool (qid, n_chunks), and how many times that it is."""
    both = each.join(pools.select("qid", "n_chunks"), "qid").withColumn("random", random_ndcg(F.col("n_chunks"), F.col("gold_count"), k))
    means = both.agg(F.count("*").alias("n"), F.avg("ndcg5").alias("m"), F.avg("random").alias("r"))
    return means.select("n", F.round("m", 6).alias("ndcg5"), F.round("r", 6).alias("random_ndcg5"), F.when(F.col("r") > 0, F.round(F.col("m") / F.col("r"), 4)).alias("lift"))


def tiers(each: DataFrame, *fields: str) -> DataFrame:
    """For each strategy the means over all its questions, by evidence group and by each of ``fields``, as (strategy, dimension, value, n and the metrics)."""
    rows = each.withColumn("evidence", evidence_group(F.col("gold_count")))
    by = ["evidence", *fields]
    for c in by:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    sets = [[F.col("strategy"), F.col(c)] for c in by] + [[F.col("strategy")]]
    out = rows.groupingSets(sets, F.col("strategy"), *[F.col(c) for c in by]).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], *[F.grouping(c).alias(f"_g_{c}") for c in by])
    dimension, value = F.lit("all"), F.lit("all")
    for c in by:
        dimension, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return out.select("strategy", dimension.alias("dimension"), value.alias("value"), "n", *METRICS)
