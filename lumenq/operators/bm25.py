"""BM25 (Okapi) over chunks, for batches of questions.

k1 = 1.5, b = 0.75; a term's idf is ln(N - n + 0.5) - ln(n + 0.5), and a negative one
becomes 0.25 of the mean idf of all terms. A question's repeated terms count each
time. With ``scope``, every value of that column is a collection of its own,
with its own N, df and mean length, and questions are asked within theirs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import tokens
from lumenq.operators import matrix, postings

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Weighted (question, term) rows that are broadcast at most: about 60 MB.
MAX_WEIGHTS = 2_000_000


def index_text(chunks: DataFrame) -> Column:
    """What a chunk is indexed by: its index text, if it has one."""
    return F.coalesce(F.col("index_text"), F.col("text")) if "index_text" in chunks.columns else F.col("text")


def tokenized(chunks: DataFrame, text: Column | None = None, distinct: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, ordinal, toks, dl and what is kept; ``distinct`` makes every term's frequency 1."""
    toks = tokens(F.col("__text"))
    toks = F.array_distinct(toks) if distinct else toks
    lean = matrix.spread(chunks.select("chunk_id", "ordinal", *keep, (index_text(chunks) if text is None else text).alias("__text")))
    return lean.select("chunk_id", "ordinal", *keep, toks.alias("toks")).withColumn("dl", F.size("toks"))


def term_stats(toks: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, term, df, idf (after the floor for negative ones), n_docs, avgdl.

    One pass counts collections, one counts terms; the mean idf comes from the counted
    terms, so the only wide data is a row for each distinct term.
    """
    totals = toks.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = toks.select(*scope, F.explode(F.array_distinct("toks")).alias("term")).groupBy(*scope, "term").agg(F.count("*").alias("df"))
    joined = df.join(totals, list(scope)) if scope else df.crossJoin(F.broadcast(totals))  # totals without scope is one row
    raw = joined.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean_idf"))
    full = raw.join(mean, list(scope)) if scope else raw.crossJoin(F.broadcast(mean))  # one row again
    return full.select(*scope, "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "n_docs", "avgdl")


def scores(chunks: DataFrame, queries: DataFrame, scope: tuple[str, ...] = (), text: Column | None = None, distinct: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, chunk_id, ordinal, kept columns and score of every chunk that shares a term with the question (qid, text, scope)."""
    toks = tokenized(chunks, text, distinct, (*scope, *(c for c in keep if c not in scope)))
    asked = queries.select("qid", *scope, F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", *scope, "term").agg(F.count("*").alias("qtf"))
    stats = term_stats(toks, scope)
    weighted = asked.join(stats, [*scope, "term"])
    # postings are cut to the terms that are asked for before anything is counted
    terms = asked.select(*scope, "term").distinct()
    others = [c for c in keep if c not in scope]
    posted = toks.select("chunk_id", "ordinal", *scope, *others, "dl", F.explode("toks").alias("term")).join(terms, [*scope, "term"], "left_semi")
    tf = posted.groupBy("chunk_id", "ordinal", *scope, *others, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(weighted, [*scope, "term"]).groupBy("qid", "chunk_id", "ordinal", *dict.fromkeys([*scope, *others])).agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, partition: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best rows of each question with ``rank`` from 1; equal scores in the order of the chunks."""
    # scores are compared after rounding, so that the order of a sum doesn't decide
    w = Window.partitionBy(*partition).orderBy(F.round("score", 9).desc(), "ordinal")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def completed(scored: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``scored`` (qid, chunk_id, ordinal, score) with the first k chunks of score 0 for the questions that have fewer than k rows above 0."""
    enough = scored.where("score > 0").groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("qid")
    short = queries.select("qid").distinct().join(enough, "qid", "left_anti")
    # a question lacks at most k rows, and its own hits are the only ones of the first chunks that it can't take
    hits = scored.join(short, "qid").groupBy("qid").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    most = hits.first().most
    first = chunks.select("chunk_id", "ordinal").orderBy("ordinal").limit(min(k + (most or 0), (1 << 31) - 1))
    zero = short.crossJoin(first).join(scored.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    return scored.select("qid", "chunk_id", "ordinal", "score").unionByName(zero.withColumn("score", F.lit(0.0)).select("qid", "chunk_id", "ordinal", "score"))


class Index:
    """A corpus with its counts, which are made in one pass when they are first asked for and then kept.

    ``scope`` makes each of its values a collection of its own; ``within`` only says, by a column that questions have too,
    which rows a question is asked in, and counts stay those of all rows. Counts and searches are passes over ``chunks``.
    """

    def __init__(self, chunks: DataFrame, scope: str | None = None, text: Column | None = None, distinct: bool = False, within: str | None = None, counts: Index | None = None):
        self.chunks, self.scope, self.within, self.distinct, self._counts = chunks, scope, within, distinct, counts
        self.text = index_text(chunks) if text is None else text

    def rows(self, *keep: str, together: str | None = None) -> DataFrame:
        by = self.scope or self.within
        return matrix.spread(self.chunks.select("chunk_id", "ordinal", *keep, self.text.alias("__text"), *([F.col(by).cast("string").alias("scope")] if by else [])), *([together] if together else []))

    def counts(self) -> DataFrame:
        if self._counts is None:
            self._counts = postings.counted(self.rows(), self.scope, self.distinct).persist()
        return self._counts.counts() if isinstance(self._counts, Index) else self._counts

    def best(self, queries: DataFrame, k: int, keep: tuple[str, ...] = (), sharing: bool = False) -> DataFrame | None:
        """(qid, chunk_id, ordinal, kept columns, score): what the k best chunks of each question (qid, text, scope) are among; with ``sharing`` only chunks that share a term with it.

        The weighted terms of the questions are collected and broadcast; None if they are too many.
        """
        sides = self.sides(queries) if k <= matrix.MAX_K else None
        return None if sides is None else postings.search(self.rows(*keep), list(keep), k, sides, self.scope or self.within, K1, B, self.distinct, sharing)

    def all(self, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame | None:
        """``best`` without a bound: every chunk with every question that is asked there, of score 0 too."""
        sides = self.sides(queries)
        return None if sides is None else postings.search(self.rows(*keep), list(keep), None, sides, self.scope or self.within, K1, B, self.distinct, False)

    def sides(self, queries: DataFrame) -> dict[str, list] | None:
        by = self.scope or self.within
        q = queries.select(F.col("qid").cast("string").alias("qid"), *([F.col(by).cast("string").alias("scope")] if by else [F.lit("").alias("scope")]), tokens(F.col("text")).alias("terms")).where("scope is not null")
        asked = q.limit(MAX_WEIGHTS + 1).toArrow().to_pylist() if MAX_WEIGHTS else []
        if not MAX_WEIGHTS or sum(max(1, len(r["terms"])) for r in asked) > MAX_WEIGHTS:
            return None
        known = sorted({t for r in asked for t in r["terms"]})
        spark = queries.sparkSession
        terms = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": pd.Series(known, dtype="str"), "__asked": True}), "term string, __asked boolean"))
        found = self.counts().join(terms, "term", "left").select("scope", F.when(F.col("__asked"), F.col("term")).alias("term"), F.col("term").isNull().alias("whole"), "n", "dl")
        few = found.groupBy("scope", "term", "whole", "n").agg(F.count("*").alias("times"), F.sum("dl").alias("dl")).limit(2 * MAX_WEIGHTS + 1).toPandas()
        if len(few) > 2 * MAX_WEIGHTS:
            return None
        weights, avgdl = {}, {}
        for scope, part in few.groupby("scope"):
            size = part[part["whole"]].iloc[0]
            each = part[~part["whole"]]
            raw = np.log(size["n"] - each["n"] + 0.5) - np.log(each["n"] + 0.5)
            floor = EPSILON * float((raw * each["times"]).sum() / max(1, each["times"].sum()))
            idf = raw.where(raw >= 0, floor)
            weights[scope], avgdl[scope] = dict(zip(each["term"], idf, strict=True)), float(size["dl"]) / float(size["n"]) or 1.0
        by_scope: dict[str, dict[str, Counter]] = {}
        for r in asked:
            by_scope.setdefault(r["scope"], {}).setdefault(r["qid"], Counter()).update(r["terms"])
        out = {}
        for scope, qs in by_scope.items():
            of = scope if self.scope else ""
            own = weights.get(of, {})
            out[scope] = postings.sliced([(qid, [(t, n * own[t]) for t, n in c.items() if t in own]) for qid, c in qs.items()], avgdl.get(of, 1.0))
        return out


def best(chunks: DataFrame, queries: DataFrame, k: int, text: Column | None = None, distinct: bool = False) -> DataFrame:
    """(qid, chunk_id, ordinal, score): what the k best chunks of each question are among, chunks of score 0 included.

    The weighted terms of the questions are collected here and broadcast; chunks are scored where they lie. More than
    ``MAX_WEIGHTS`` of these, or more than ``matrix.MAX_K`` ranks, are scored by joins.
    """
    found = Index(chunks, text=text, distinct=distinct).best(queries, k)
    return completed(scores(chunks, queries, text=text, distinct=distinct), chunks, queries, k) if found is None else found


def best_sharing(chunks: DataFrame, queries: DataFrame, k: int, scope: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """``best`` of the chunks that share a term with the question, each value of ``scope`` a collection of its own; with the columns of ``scope``."""
    found = Index(chunks, scope[0] if scope else None, distinct=distinct).best(queries, k, scope, True) if len(scope) < 2 else None
    return scores(chunks, queries, scope, distinct=distinct) if found is None else found


def retrieve(chunks: DataFrame | Index, queries: DataFrame, k: int = 5, scope: tuple[str, ...] = ()) -> DataFrame:
    """The k best chunks of each question, as (qid, chunk_id, ordinal, rank, score, score_kind); without scope there are min(k, chunks) of them."""
    if isinstance(chunks, Index):
        found = chunks.best(queries, k)
        found = best(chunks.chunks, queries, k) if found is None else found
    else:
        found = best_sharing(chunks, queries, k, scope) if scope else best(chunks, queries, k)
    out = top(found, k).select("qid", "chunk_id", "ordinal", "rank", "score", F.lit("bm25").alias("score_kind"))
    # the list is small and read again by most of what follows, which would search again each time
    return out.persist() if k <= matrix.MAX_K else out
