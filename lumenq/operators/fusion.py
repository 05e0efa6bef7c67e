"""Fusing ranked lists, ordered unions, and caps that reorder.

A ranked list is (qid, chunk_id, ordinal, rank, ...), with rank from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CANDIDATES = 60, 100


def rrf(lists: list[tuple[DataFrame, float]], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion. Equal scores are in the order of the first list, then of the next ones, then of the chunks.

    One union and one aggregation, whatever the number of lists.
    """
    tagged = [x.select("qid", "chunk_id", "ordinal", "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("weight")) for i, (x, w) in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    places = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"_rank{i}") for i in range(len(lists))]
    fused = rows.groupBy("qid", "chunk_id").agg(F.min("ordinal").alias("ordinal"), F.sum(F.col("weight") / (F.lit(rrf_k) + F.col("rank"))).alias("score"), *places)
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), *[F.col(f"_rank{i}").asc_nulls_last() for i in range(len(lists))], "ordinal")
    out = fused.withColumn("rank", F.row_number().over(w).cast("long"))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("qid", "chunk_id", "ordinal", "rank", "score", F.lit("rrf").alias("score_kind"))


def multi_query_rrf(variant_lists: DataFrame, k: int, rrf_k: int = RRF_K, first: float = 1.0, others: float = 0.7) -> DataFrame:
    """Fuses each question's variants, (qid, variant, chunk_id, ordinal, rank); variant 0, the question itself, weighs ``first``."""
    weight = F.when(F.col("variant") == 0, first).otherwise(others)
    fused = variant_lists.groupBy("qid", "chunk_id").agg(F.min("ordinal").alias("ordinal"), F.sum(weight / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("variant", "rank")).alias("_first"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "_first", "ordinal")
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "chunk_id", "ordinal", "rank", "score", F.lit("multi_rrf").alias("score_kind"))


def ordered_union(lists: list[DataFrame], columns: tuple[str, ...] = ("qid", "chunk_id", "ordinal", "score")) -> DataFrame:
    """One list after the other, each chunk where it comes first; rows without a chunk id go."""
    rows = reduce(DataFrame.unionByName, [x.select(*columns, "rank").withColumn("_list", F.lit(i)) for i, x in enumerate(lists)])
    rows = rows.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != ""))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("_list", "rank"))).where("_n = 1")
    w = Window.partitionBy("qid").orderBy("_list", "rank")
    return first.withColumn("_new", F.row_number().over(w).cast("long")).select(*columns, F.col("_new").alias("rank"))


def capped(ranked: DataFrame, column: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each value first; what is over follows, in its order. Nothing is dropped."""
    nth = F.row_number().over(Window.partitionBy("qid", column).orderBy("rank"))
    over = ranked.withColumn("_over", nth > cap)
    return over.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_over", "rank")).cast("long")).drop("_over")


def neighbours(ranked: DataFrame, chunks: DataFrame, window: int = 1, paper: str = "doc_id", decay: float = 0.01) -> DataFrame:
    """Chunks up to ``window`` places from a ranked one in its document, with a score that falls by ``decay`` a place."""
    placed = chunks.withColumn("place", F.row_number().over(Window.partitionBy(paper).orderBy("ordinal")))
    anchors = ranked.select("qid", F.col("chunk_id").alias("anchor_id"), F.col("score").alias("anchor_score")).join(placed.select(F.col("chunk_id").alias("anchor_id"), paper, F.col("place").alias("at")), "anchor_id")
    # an equi-join on document and place instead of a range join
    steps = anchors.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d])))
    near = steps.withColumn("place", F.col("at") + F.col("d")).join(placed.select(paper, "place", "chunk_id", "ordinal"), [paper, "place"])
    return near.select("qid", "anchor_id", "chunk_id", "ordinal", F.abs("d").alias("distance"), (F.col("anchor_score") - decay * F.abs("d")).alias("score"))
