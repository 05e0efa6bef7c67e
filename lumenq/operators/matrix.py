"""Top-k search by one matrix product for each Arrow batch of the corpus.

The questions' side is collected and broadcast, so it is size-checked by the callers; the corpus stays where it lies,
and each batch hands on its k best rows of each question, which alone are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Questions of one dense slice, and numbers that a block of scores has at most.
SLICE, BLOCK = 256, 4_000_000
#: Ranks up to which the k best of each batch are fewer rows than all.
MAX_K = 1000


#: Bytes of a corpus, as planned, up to which it is spread over all cores first: one file of a few row groups would be one task.
SMALL = 1 << 30


def spread(corpus: DataFrame, *by: str) -> DataFrame:
    """A small corpus in as many partitions as there are cores, with rows of equal ``by`` together; a large one as it is."""
    spark = corpus.sparkSession
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return corpus.repartition(spark.sparkContext.defaultParallelism, *by) if size <= SMALL else corpus


def best_rows(score: np.ndarray, ordinals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each column (score as rounded to 9 places, then ordinal); NaN comes last."""
    n, m = score.shape
    r = np.where(np.isnan(score), -np.inf, np.round(score, 9))
    if n <= k:
        return np.tile(np.arange(n), m), np.repeat(np.arange(m), n)
    least = np.partition(r, n - k, axis=0)[n - k]
    rows, cols = [], []
    for c in range(m):
        some = np.flatnonzero(r[:, c] >= least[c])
        rows.append(some[np.lexsort((ordinals[some], -r[some, c]))[:k]])
        cols.append(np.full(k, c))
    return np.concatenate(rows), np.concatenate(cols)


def search(corpus: DataFrame, columns: list[str], k: int, slices: list, score: Callable[[pa.RecordBatch, object], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(qid, chunk_id, ordinal, score): each batch's k best rows of each question.

    ``slices`` has (qids, whatever ``score`` needs) of at most SLICE questions; ``score`` yields (first row, scores of rows x questions).
    """
    shared = corpus.sparkSession.sparkContext.broadcast(slices)
    schema = T.StructType([T.StructField("qid", T.StringType()), corpus.schema["chunk_id"], corpus.schema["ordinal"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ordinals = b.column("ordinal").to_numpy(zero_copy_only=False)
            for qids, side in shared.value:
                for first, s in score(b, side):
                    rows, cols = best_rows(s, ordinals[first : first + len(s)], k)
                    at, values = pa.array(rows + first), s[rows, cols]
                    yield pa.RecordBatch.from_arrays([pa.array(qids).take(pa.array(cols)).cast(pa.string()), b.column("chunk_id").take(at), b.column("ordinal").take(at), pa.array(values, mask=np.isnan(values))], names=schema.names)

    return corpus.select("chunk_id", "ordinal", *columns).mapInArrow(run, schema)


def term_slices(qids: list[str], asked: pa.Table) -> list[tuple[list[str], tuple]]:
    """Slices of questions: their terms, and where in the table of terms x questions which weight stands; ``asked`` has qid, term, weight."""
    out = []
    for i in range(0, len(qids), SLICE):
        own = qids[i : i + SLICE]
        part = asked.filter(pc.is_in(asked["qid"], value_set=pa.array(own, pa.string())))
        terms = pc.unique(part["term"]).cast(pa.string())
        q = pc.index_in(part["qid"], value_set=pa.array(own, pa.string())).to_numpy()
        at = pc.index_in(part["term"], value_set=terms).to_numpy().astype(np.int64) * len(own) + q
        out.append((own, (terms, len(own), at, part["weight"].to_numpy())))
    return out


def term_scores(k1: float, b: float, avgdl: float) -> Callable:
    """Scores of batches with ``toks`` (list of terms) against term slices: the sum of weight x saturated term frequency."""

    def score(batch: pa.RecordBatch, side: tuple) -> Iterator[tuple[int, np.ndarray]]:
        terms, width, at, values = side
        dense = np.zeros(max(1, len(terms)) * width)
        dense[at] = values
        dense = dense.reshape(-1, width)
        lists = batch.column("toks")
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False) if len(terms) else np.full(int(dl.sum()), np.nan)
        hit = ~np.isnan(found)
        n = len(terms) or 1
        code, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[hit] * n + found[hit].astype(np.int64), return_counts=True)
        row, term = np.divmod(code, n)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl)) if len(row) else np.zeros(0)
        starts = np.searchsorted(row, np.arange(len(dl) + 1))
        total = np.zeros((len(dl), width))
        step, i = max(1, BLOCK // width), 0
        while i < len(dl):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + step, side="right")) - 1)
            s, e = starts[i], starts[j]
            if e > s:
                some = np.flatnonzero(np.diff(starts[i : j + 1]))
                total[i + some] = np.add.reduceat(part[s:e, None] * dense[term[s:e]], starts[i:j][some] - s, axis=0)
            i = j
        yield 0, total

    return score


def dot_scores(batch: pa.RecordBatch, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products in double precision; NaN where a row's vector is null, has a null or has another length."""
    lists, dim = batch.column("vec"), vectors.shape[1]
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
    some = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    out = np.full((batch.num_rows, len(vectors)), np.nan)
    if len(some):
        flat = lists.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        out[some] = flat @ vectors.T
    yield 0, out
