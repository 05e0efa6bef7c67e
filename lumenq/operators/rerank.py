"""Scoring (question, chunk) pairs, and reranking by it.

A pair scorer maps two columns of texts to a score. ``overlap_f1`` is the offline
default: built-in expressions, no model. ``from_model`` wraps any Python
callable over batches of pairs, such as a cross-encoder's ``predict``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import tokens

PairScorer = Callable[[Column, Column], Column]


def overlap_f1(question: Column, text: Column) -> Column:
    """F1 of the two sets of tokens, shifted to -1 .. 1 so that a pair without overlap is below 0."""
    a, b = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total > 0, 4.0 * both / total - 1.0).otherwise(F.lit(-1.0))


def from_model(predict: Callable[[list[tuple[str, str]]], list[float]]) -> PairScorer:
    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return lambda q, t: score(q, t)


#: Ids up to which chunks are filtered by a broadcast of a list's, so that no other chunk is moved to be joined with it.
LISTED = 1_000_000


def listed(chunks: DataFrame, ranked: DataFrame, column: str = "chunk_id") -> DataFrame:
    """The chunks whose id (or other column) a list has, or all if it has too many."""
    own = ranked.select(column).distinct()
    return chunks.join(F.broadcast(own), column, "left_semi") if own.limit(LISTED + 1).count() <= LISTED else chunks


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int | None = None, scorer: PairScorer = overlap_f1) -> DataFrame:
    """Candidates (qid, chunk_id, ordinal, rank) in the order of their pair scores; equal ones keep theirs."""
    texts = listed(chunks, candidates).select("chunk_id", F.col("text").alias("_text"))
    asked = queries.select("qid", F.col("text").alias("_question"))
    pairs = candidates.select("qid", "chunk_id", "ordinal", F.col("rank").alias("_was")).join(texts, "chunk_id").join(asked, "qid")
    # scoring is work on few bytes, so their number mustn't say how many tasks there are; ranks are taken in the same partitions
    spark = pairs.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scored = pairs.repartition(n, "qid").withColumn("score", scorer(F.col("_question"), F.col("_text")))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "_was")
    out = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("qid", "chunk_id", "ordinal", "rank", "score", F.lit("pair").alias("score_kind"))
