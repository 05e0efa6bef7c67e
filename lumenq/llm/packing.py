"""Packing documents into bins of a fixed number of tokens by minimum bin slack.

For each bin, subset sums over the lengths that are still there are kept as the
bits of an integer, and the fullest feasible combination that holds the longest
remaining piece is found and taken out. Documents longer than a bin are cut
into full bins and a rest. Groups of documents, by a hash of ``doc_id`` and
about ``group_docs`` each however large the corpus, are packed side by side.

A length is the number of a text's token ids (``bpe``), or what a column of the
caller's says. Edges: a null or empty text, and a length that is null or below 1, is
in no bin; null and repeated ``doc_id``s are packed row by row; equal lengths are
taken in the order of their rows; the empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm import bpe, textvec
from lumenq.llm.shared import table

CAPACITY = 2048
GROUP_DOCS = 8192
#: Tasks that pack at most; each takes several groups beyond.
MAX_TASKS = 20_000
SCHEMA = "bin_id string, capacity int, used int, slack int, doc_ids array<bigint>, starts array<int>, lengths array<int>"


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, with repeats, whose sum is the largest that is at most ``room``; ``lengths`` lists the keys in descending order."""
    mask = (1 << (room + 1)) - 1
    reach, steps, goal = 1, [], 1 << room
    for x in lengths:
        if x > room:
            continue
        for _ in range(min(counts[x], room // x)):
            more = (reach | (reach << x)) & mask
            if more == reach:
                break
            steps.append((x, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        if not (before >> total) & 1:
            taken.append(x)
            total -= x
    return taken


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of positions in ``lengths`` (each of 1 .. capacity)."""
    if any(not 0 < x <= capacity for x in lengths):
        raise ValueError("a length is outside 1 .. capacity")
    where: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        where.setdefault(int(lengths[i]), []).append(i)
    counts = {x: len(v) for x, v in where.items()}
    order, bins = sorted(counts, reverse=True), []
    first = 0
    while first < len(order):
        top = order[first]
        counts[top] -= 1
        taken = [top, *fullest(counts, [x for x in order[first:] if counts[x]], capacity - top)]
        for x in taken[1:]:
            counts[x] -= 1
        bins.append([where[x].pop() for x in taken])
        if len(order) - first > 64 and sum(counts[x] == 0 for x in order[first : first + 64]) > 32:
            order = [x for x in order[first:] if counts[x]]
            first = 0
        while first < len(order) and not counts[order[first]]:
            first += 1
    return bins


def _pack(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"].tolist()]
        out, pieces = [], []
        group = int(key[0])

        def add(parts: list[tuple]) -> None:
            used = sum(p[2] for p in parts)
            out.append((f"{group:08d}-{len(out):06d}", capacity, used, capacity - used, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))

        for d, n in zip(ids, rows["n"].tolist(), strict=True):
            for s in range(0, n - n % capacity, capacity):
                add([(d, s, capacity)])
            if n % capacity:
                pieces.append((d, n - n % capacity, n % capacity))
        for b in pack_lengths([p[2] for p in pieces], capacity):
            add([pieces[i] for i in b])
        return pd.DataFrame(out, columns=["bin_id", "capacity", "used", "slack", "doc_ids", "starts", "lengths"])

    return run


def _lengths(vocabulary: str):
    """Token ids per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.Coder.of(vocabulary)
        for b in batches:
            offs, _ = textvec.utf8(b.column("text"))
            n = np.zeros(len(offs) - 1, np.int32)
            for i, j in textvec.pieces(offs, bpe.STEP_BYTES):
                n[i:j] = np.diff(coder.batch(b.column("text").slice(i, j - i))[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n)], names=["doc_id", "n"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, length: str | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Bins: bin_id, capacity, used, slack and, for each piece, its doc_id, first token and number of tokens.

    ``length`` names a column of whole numbers, as ``n_tokens`` of the token operators; without it, texts are encoded to be counted.
    """
    own = F.col("doc_id").cast("long").alias("doc_id")
    sized = docs.select(own, F.col(f"`{length}`").cast("int").alias("n")) if length else docs.select(own, "text").mapInArrow(_lengths(vocabulary), "doc_id long, n int")
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    keyed = sized.where("n > 0").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    # a group is seconds of work on kilobytes of lengths, so their bytes mustn't say how many tasks there are
    spread = keyed.repartition(min(groups, MAX_TASKS), "g")
    return spread.groupBy("g").applyInPandas(_pack(capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that hold every document."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
