"""Dense vectors: an offline encoder, exact cosine scores, and approximate search by hashing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.operators import matrix
from lumenq.operators.bm25 import top

#: Vectors up to which the questions' side is broadcast against the corpus.
BROADCAST_QUERIES = 10_000


def hashed_vector(text: str | None, dim: int = 64) -> list[float]:
    """A stand-in encoder: signed counts of hashed tokens, of unit length. It is no language model."""
    import hashlib
    import re

    v = np.zeros(dim)
    for t in re.findall("[a-z0-9]+", (text or "").lower()):
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def encode(rows: DataFrame, text: str = "text", encoder: Callable[[str], list[float]] = hashed_vector) -> DataFrame:
    """``rows`` with ``vec``; the encoder runs over Arrow batches, loaded once in each worker."""

    @F.pandas_udf("array<float>")
    def vec(texts: pd.Series) -> pd.Series:
        return texts.map(encoder)

    return rows.withColumn("vec", vec(text))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null where one is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scores(vectors: DataFrame, queries: DataFrame, n_queries: int | None = None) -> DataFrame:
    """qid, chunk_id, ordinal, score of every vector (chunk_id, ordinal, vec) for every question (qid, qvec)."""
    n = queries.count() if n_queries is None else n_queries
    side = F.broadcast(queries) if n <= BROADCAST_QUERIES else queries.repartition("qid")
    return vectors.crossJoin(side.select("qid", "qvec")).select("qid", "chunk_id", "ordinal", dot(F.col("vec"), F.col("qvec")).alias("score"))


def retrieve(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best vectors of each question. Up to BROADCAST_QUERIES questions are collected here and multiplied with each batch of vectors; more are crossed with them."""
    asked = queries.select(F.col("qid").cast("string").alias("qid"), "qvec").limit(BROADCAST_QUERIES + 1).collect() if k <= matrix.MAX_K else []
    asked = sorted((r for r in asked if r.qvec is not None), key=lambda r: r.qid)
    if asked and len(asked) <= BROADCAST_QUERIES and len({len(r.qvec) for r in asked}) == 1:
        q = np.array([r.qvec for r in asked], dtype=np.float64)
        slices = [([r.qid for r in asked[i : i + matrix.SLICE]], q[i : i + matrix.SLICE]) for i in range(0, len(asked), matrix.SLICE)]
        found = matrix.search(vectors, ["vec"], k, slices, matrix.dot_scores)
    else:
        found = scores(vectors, queries)
    out = top(found, k).select("qid", "chunk_id", "ordinal", "rank", "score", F.lit("dense").alias("score_kind"))
    return out.persist() if k <= matrix.MAX_K else out


def retrieve_hashed(vectors: DataFrame, queries: DataFrame, k: int = 50, tables: int = 24, bits: int = 6, seed: int = 11, flips: int = 2) -> DataFrame:
    """Approximate: only vectors in a bucket that the question probes in some table are scored, exactly.

    In each table of random hyperplanes a question probes its own bucket, and the ``flips`` buckets across the single
    hyperplanes that it lies nearest to.
    """
    from functools import reduce

    dim = len(vectors.select("vec").first()[0])
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))

    def buckets(c: Column) -> Column:
        out = []
        for t in range(tables):
            sides = [F.when(dot(c, F.array(*[F.lit(float(x)) for x in planes[t, b]])) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)]
            out.append(reduce(lambda a, b: a + b, sides) + F.lit(t << bits))
        return F.array(*out)

    def nearest(c: Column) -> Column:
        """For each table, the bits of its hyperplanes by their distance from the vector."""
        return F.array(*[F.array_sort(F.array(*[F.struct(F.abs(dot(c, F.array(*[F.lit(float(x)) for x in planes[t, b]]))).alias("far"), F.lit(1 << b).alias("bit")) for b in range(bits)])) for t in range(tables)])

    left = vectors.select("chunk_id", "ordinal", "vec", buckets(F.col("vec")).alias("own")).select("*", F.explode("own").alias("bucket"))
    tables_of = F.arrays_zip(buckets(F.col("qvec")).alias("own"), nearest(F.col("qvec")).alias("near"))
    probes = F.flatten(F.transform(tables_of, lambda t: F.concat(F.array(t["own"]), F.transform(F.slice(t["near"], 1, flips), lambda s: t["own"].bitwiseXOR(s["bit"])))))
    right = queries.select("qid", "qvec", probes.alias("probes")).select("*", F.explode("probes").alias("bucket"))
    # a pair counts in the first table where it meets, so that pairs needn't be moved to drop repeats
    met = left.join(right, "bucket").where(F.array_min(F.array_intersect("own", "probes")) == F.col("bucket"))
    return top(met.select("qid", "chunk_id", "ordinal", dot(F.col("vec"), F.col("qvec")).alias("score")), k).withColumn("score_kind", F.lit("dense"))


def class_scores(questions: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Prototype classification: for each qid the label of the highest 0.75 max + 0.25 mean similarity, that score, and its margin over the runner-up."""
    from pyspark.sql import Window

    pairs = questions.select("qid", "qvec").crossJoin(F.broadcast(prototypes.select("label", "vec")))  # prototypes are a few dozen fixed examples
    each = pairs.withColumn("s", dot(F.col("qvec"), F.col("vec"))).groupBy("qid", "label").agg((0.75 * F.max("s") + 0.25 * F.avg("s")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "label")
    ranked = each.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return ranked.groupBy("qid").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.round(F.max("score"), 4).alias("score"), F.round(F.max("score") - F.min("score"), 4).alias("margin"))
