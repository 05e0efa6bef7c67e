"""Resharding by minimum-cost flow.

Shards have sizes in bytes and the new ones capacities. A flow from old to new
shards, by successive shortest paths, moves the fewest bytes: what stays in a
shard that still exists costs nothing, a byte that moves costs 1 (or what
``cost`` says). Rows move in blocks, ranges of ``doc_id`` within an old shard that
hold about as many bytes each (quantiles of ``doc_id`` weighted by bytes), at
most ``BLOCKS`` of them in each shard and ``ALL_BLOCKS`` in all however many rows there are, so that
sizes, flow and assignment are metadata whose size is bounded. A
shard's blocks fill its flows in order; a block on the border of two goes where
more of it belongs, so a new shard may exceed its capacity by one block; the plan's
``overrun`` says by how much the fullest one does.

Only files of shards that lose or gain blocks are written again; the others keep
theirs. Edges: a null shard or id is in shard or block "" / -1; rows of equal ids
move together, so a block may be as large as they are; capacities that are too
small, and ids that are no numbers, raise ValueError; an empty table gives an empty
plan; other columns are carried, but old_shard, block, new_shard and moved are replaced.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.shared import local_path, new_dir, table

BLOCKS, ALL_BLOCKS = 1024, 1 << 18
#: Draws for each block that its bounds are quantiles of.
DRAWS = 64
#: Bytes of one file that is written again.
FILE_BYTES = 128 << 20
#: The new layout: this many shards more than the old one, of equal capacity with this slack.
MORE_SHARDS, SLACK = 4, 1.02


def min_cost_flow(supply: dict[str, int], capacity: dict[str, int], cost=None) -> dict[tuple[str, str], int]:
    """Bytes from each old to each new shard of the cheapest flow; ``cost(old, new)`` per byte, 0 for the same name and else 1 by default.

    With the default costs some cheapest flow leaves in each shard all that it can hold, so only surpluses are solved for.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards can't hold the old ones' bytes")
    stay = {} if cost else {(a, a): min(n, capacity[a]) for a, n in supply.items() if min(n, capacity.get(a, 0))}
    rest = {a: n - stay.get((a, a), 0) for a, n in supply.items()}
    room = {b: n - stay.get((b, b), 0) for b, n in capacity.items()}
    left, right = sorted(a for a in rest if rest[a]), sorted(b for b in room if room[b])
    costs = np.array([[cost(a, b) for b in right] for a in left], np.int64) if cost else np.ones((len(left), len(right)), np.int64)
    flow = _shortest_paths(costs.reshape(len(left), len(right)), np.array([rest[a] for a in left], np.int64), np.array([room[b] for b in right], np.int64))
    return stay | {(left[i], right[j]): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def _shortest_paths(c: np.ndarray, rest: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Successive shortest paths with potentials over the bipartite network; all sources at one distance are settled at once."""
    n, m = c.shape
    far = np.int64(1) << 60
    flow = np.zeros((n, m), np.int64)
    pot_l = np.zeros(n, np.int64)
    pot_r = c.min(axis=0) if n else np.zeros(m, np.int64)
    pot_end = pot_r[room > 0].min() if n else 0
    while rest.any():
        dl, dr = np.where(rest > 0, 0, far), np.full(m, far)
        from_l, from_r = np.full(n, -1), np.full(m, -1)
        done_l, done_r = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
        end, nearest = -1, far
        while True:
            near_l = np.where(done_l, far, dl).min()
            near_r = np.where(done_r, far, dr).min()
            if min(near_l, near_r) >= nearest:
                break
            if near_l <= near_r:
                at = np.flatnonzero(~done_l & (dl == near_l))
                done_l[at] = True
                way = c[at] + pot_l[at, None]
                best = way.argmin(axis=0)
                d = near_l + way[best, np.arange(m)] - pot_r
                better = ~done_r & (d < dr)
                dr[better], from_r[better] = d[better], at[best[better]]
                continue
            ends = np.flatnonzero(~done_r & (dr == near_r))
            done_r[ends] = True
            open_ends = ends[room[ends] > 0]
            if len(open_ends):
                k = int(open_ends[pot_r[open_ends].argmin()])
                if near_r + pot_r[k] - pot_end < nearest:
                    end, nearest = k, near_r + pot_r[k] - pot_end
            for j in ends.tolist():
                d = near_r - c[:, j] + pot_r[j] - pot_l
                better = ~done_l & (flow[:, j] > 0) & (d < dl)
                dl[better], from_l[better] = d[better], j
        pot_l += np.minimum(dl, nearest)
        pot_r = pot_r + np.minimum(dr, nearest)
        pot_end += nearest
        path, j = [], end
        while True:
            i = int(from_r[j])
            path.append((i, j))
            if from_l[i] < 0:
                break
            j = int(from_l[i])
            path.append((i, j))
        amount = min([int(rest[path[-1][0]]), int(room[end]), *(int(flow[p]) for p in path[1::2])])
        for k, p in enumerate(path):
            flow[p] += -amount if k % 2 else amount
        rest[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def assign_blocks(sizes: dict[tuple[str, int], int], flow: dict[tuple[str, str], int]) -> dict[tuple[str, int], str]:
    """The new shard of each block (old shard, block): what stays comes first, then the others by name."""
    out = {}
    by_old: dict[str, list] = {}
    for (a, new), x in flow.items():
        by_old.setdefault(a, []).append((new != a, new, x))
    blocks_of: dict[str, list[int]] = {}
    for a, block in sizes:
        blocks_of.setdefault(a, []).append(block)
    for old in sorted(blocks_of):
        parts = sorted(by_old.get(old, []))
        bounds, at = [], 0
        for _, new, x in parts:
            at += x
            bounds.append((at, new))
        at, k = 0, 0
        for block in sorted(blocks_of[old]):
            size = sizes[old, block]
            while k + 1 < len(bounds) and at + size / 2 > bounds[k][0]:
                k += 1
            out[old, block] = bounds[k][1] if bounds else old
            at += size
    return out


def layout(total: int, old: list[str], more: int = MORE_SHARDS, slack: float = SLACK) -> dict[str, int]:
    """Equal capacities for the old shards and ``more`` new ones."""
    names = [*old, *(f"new{k}" for k in range(more))]
    return {name: int(total * slack / len(names)) + 1 for name in names} if old else {}


def _bounds(keyed: DataFrame, supply: dict[str, int], blocks: int) -> dict[str, np.ndarray]:
    """For each shard, the ids at which its blocks 1, 2, ... begin: quantiles of a draw of ids in proportion to their bytes, which the executors sum up."""
    unit = max(1, sum(supply.values()) // (blocks * DRAWS * max(1, len(supply))))
    chance = F.pmod(F.xxhash64("doc_id", "old_shard"), F.lit(unit))
    drawn = keyed.where(F.col("doc_id").isNotNull()).withColumn("times", F.floor((F.col("bytes") + chance) / unit).cast("int")).where("times > 0")
    each = drawn.select("old_shard", "doc_id", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    at = F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10 * blocks) if blocks > 1 else F.array().cast("array<long>")
    return {r.old_shard: np.unique(np.array(r.at, np.int64)) for r in each.groupBy("old_shard").agg(at.alias("at")).collect()}  # blocks x shards numbers


def reshard(docs: DataFrame, shard: str = "source", capacities=layout, blocks: int = BLOCKS) -> tuple[DataFrame, dict]:
    """``docs`` with old_shard, block, new_shard and moved; and the plan: sizes, capacities, flow, the bytes that must and do move, the overrun of the fullest new shard."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id is no whole number")
    old = F.coalesce(F.col(f"`{shard}`").cast("string"), F.lit(""))
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), old.alias("old_shard"), bytes_of.alias("bytes"))
    supply = {r.old_shard: int(r.n) for r in lean.groupBy("old_shard").agg(F.sum("bytes").alias("n")).collect()}  # a row for each shard
    fit = max(1, min(blocks, ALL_BLOCKS // max(1, len(supply))))
    bounds = spark.sparkContext.broadcast(_bounds(lean, supply, fit) if supply else {})

    @F.pandas_udf("long")
    def block_of(name: pd.Series, key: pd.Series) -> pd.Series:
        out = np.full(len(key), -1, np.int64)
        there = key.notna().to_numpy()
        for x in name[there].unique():
            own = there & (name == x).to_numpy()
            out[own] = np.searchsorted(bounds.value.get(x, np.zeros(0, np.int64)), key[own].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    block = block_of("old_shard", F.col("doc_id").cast("long"))
    found = lean.withColumn("block", block).groupBy("old_shard", "block").agg(F.sum("bytes").alias("n")).collect()  # ALL_BLOCKS rows at most, and one more for each shard
    sizes = {(r.old_shard, r.block): int(r.n) for r in found}
    capacity = capacities(sum(supply.values()), sorted(supply)) if callable(capacities) else dict(capacities)
    flow = min_cost_flow(supply, capacity)
    to = assign_blocks(sizes, flow)
    new_size: dict[str, int] = {}
    part: dict[tuple[str, int], int] = {}
    for k in sorted(to):
        part[k] = new_size.get(to[k], 0) // FILE_BYTES
        new_size[to[k]] = new_size.get(to[k], 0) + sizes[k]
    schema = T.StructType([T.StructField("old_shard", T.StringType()), T.StructField("block", T.LongType()), T.StructField("new_shard", T.StringType()), T.StructField("__part", T.IntegerType())])
    plan = spark.createDataFrame([(a, b, new, part[a, b]) for (a, b), new in to.items()], schema)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("old_shard", "block", "new_shard", "moved")]
    keyed = docs.select(*others, old.alias("old_shard")).withColumn("block", block)
    # ALL_BLOCKS rows and one more for each shard at most
    out = keyed.join(F.broadcast(plan), ["old_shard", "block"], "left")
    out = out.select(*others, "old_shard", "block", "new_shard", (F.col("old_shard") != F.col("new_shard")).alias("moved"), "__part")
    moved = sum(n for k, n in sizes.items() if to[k] != k[0])
    return out, {"sizes": supply, "capacities": capacity, "flow": {f"{a}>{b}": x for (a, b), x in flow.items()}, "must_move": sum(x for (a, b), x in flow.items() if a != b), "moved": moved, "overrun": max([0, *(n - capacity.get(s, 0) for s, n in new_size.items())]), "affected": sorted({s for (a, _), b in to.items() if a != b for s in (a, b)})}


def rewrite(assigned: DataFrame, plan: dict, folder: str) -> str:
    """Files of the affected shards under ``folder``, by new shard, and a manifest that names them and is written last.

    The committed files are those under the manifest; the shards it lists as untouched keep their old ones.
    """
    spark = assigned.sparkSession
    touched = assigned.where(F.col("new_shard").isin(plan["affected"])) if plan["affected"] else assigned.limit(0)
    # a shard's rows are spread over tasks by runs of blocks of FILE_BYTES, so that a large shard isn't one task's
    touched.repartition(F.col("new_shard"), F.col("__part")).drop("moved", "__part").write.partitionBy("new_shard").parquet(f"{folder}/data")
    manifest = {k: plan[k] for k in ("capacities", "flow", "must_move", "moved", "affected")} | {"untouched": sorted(set(plan["capacities"]) - set(plan["affected"]))}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/._manifest.json.tmp")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    if not fs.rename(temp, path):
        raise OSError(f"can't commit {path.toString()}")
    return f"{folder}/data"


def read_manifest(folder: str) -> dict:
    with open(os.path.join(local_path(folder), "_manifest.json")) as f:
        return json.load(f)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's old and new shard, after the affected shards' files were written again."""
    docs = table(spark, sf_dir, "documents")
    out, plan = reshard(docs)
    rewrite(out, plan, new_dir(spark, "shards"))
    return out.select("doc_id", "old_shard", "block", "new_shard", "moved")
