"""Self-join of documents by the Jaccard similarity of their word n-grams, with a token-group matrix.

1. Documents with the same n-grams are one set from here on, with a number. Sets of
   more than 2 * ``SAMPLE`` n-grams keep the n-grams of their universe: those whose
   hash starts with so many zero bits that SAMPLE to 2 * SAMPLE are left; smaller
   sets keep all. The same pass counts what is kept in a sketch of fixed size.
2. What a set keeps is put in the sketch's order, rare n-grams first, so that
   passages which many documents share come last. A set of s n-grams has an overlap
   of at least a = ceil(threshold * s) with any similar one, so the two agree in m of their
   first s - a + m (the prefix filter), m being ``MATCHES`` or a if that is less.
   Where universes are sampled, s and a are those of the sample, at a threshold lower by ``MARGIN``.
3. Sets are partitioned into groups: each takes the key of its prefix that most
   sets have, then moves to the most popular group whose bound it reaches, so that
   near copies meet in one group, or few where that is split at ``GROUP_GRAMS``
   n-grams together. The matrix has, for each key, the groups whose union of
   prefixes holds it; keys that one set has alone are left out. A set's overlap with
   a group's union bounds its overlap with any member; groups where it is
   less than m, or whose members are all too small or too large, are never opened.
4. Qualifying groups are opened: first the members' and the queries' samples come
   together (all n-grams of small sets, so that this decides them but for
   collisions), and sets without a partner whose sampled similarity is at most ``SCREEN``
   below the threshold go; then the texts of those that are left, and every pair's
   similarity is computed from the whole sets.

Every document is a query; no number of partners or candidates is cut off.
The query has a row for each document: its class (what links connect, in one step
or several) and the number of its links, copies included. A group of similar texts
has links as the square of its size, so these are counted where its group is opened and
never are rows; ``join`` writes them out as pairs for those who want each.
Reported similarities are exact up to collisions of 64-bit hashes. Pairs in which one
set has 2 * SAMPLE n-grams at most are never missed. Of larger ones a pair can be, where fewer of the common n-grams
fall in the sample than MARGIN allows for: with at most 5 % probability for a pair exactly at
0.65 of which one set contains the other (the worst case), less for any other; tests hold it
against brute force.

Terms are as in ``textvec``. Edges: null or empty texts and texts without terms
resemble nothing, not even each other; a text of fewer terms than N has one gram
of all; rows with a null doc_id are left out; repeated rows count once; a doc_id
with several texts is similar to what any of them is, by the greatest
similarity, and connects what these are similar to; an empty table has no pairs; other
columns are ignored. A document without links is a class of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.llm import textvec
from lumenq.llm.shared import among, drop, table, written

N, THRESHOLD, SAMPLE, MARGIN, MATCHES, SCREEN = 2, 0.65, 64, 0.1, 4, 0.15
#: N-grams that the members, and the queries, of one opened group have together at most (8 bytes each); one set may have more.
GROUP_GRAMS, QUERY_GRAMS = 3_000_000, 3_000_000
#: The sketch has 2 ** SKETCH_BITS counters of one byte (16 MB), whatever the corpus; a counter c stands for 2 ** (c / 6) n-grams.
SKETCH_BITS, BLOCK_BITS = 24, 18
#: Documents of sets with several up to which these are broadcast to write out the pairs; beyond, a join.
BROADCAST_COPIES = 2_000_000
#: Copies of one set that a task pairs with all the others.
COPIES = 2000
PAIRS = "a long, b long, doc_a long, doc_b long, jaccard double"
#: Without b, the links that a has in one opened group; with b, a pair that connects or, where ``odd``, one that is counted by itself.
LINKS = "a long, b long, links long, odd boolean"
SURVEY = "sid binary, fat boolean, doc_id long, th long, n int, hi binary, lo binary, cuts binary, block int, counts binary"
SETS = "sno long, lead boolean, doc_id long, th long, n int, hi binary, lo binary, cuts binary, block int, counts binary"
#: Sets whose sample a task has given already, and gives no more.
SEEN = 1_000_000

_U = np.uint64
_EPS = 1e-9


def set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def power(size: float) -> int:
    """The universe of a set of that size: n-grams whose hash starts with so many zero bits."""
    return max(0, int(np.floor(np.log2(max(size, 1) / SAMPLE))))


def least_overlap(size: int, threshold: float) -> int:
    """What a set of that size has in common at least with a similar one."""
    return max(1, int(np.ceil(threshold * size - _EPS)))


def matches(size: int, threshold: float) -> int:
    """The prefix keys that it has in common with a similar one at least."""
    return min(MATCHES, least_overlap(size, threshold))


def cuts_of(grams: np.ndarray, threshold: float) -> np.ndarray:
    """How many of the ascending hashes are in each universe where the set may meet a similar one: its own, and those of larger partners."""
    size = len(grams)
    low, high = power(size), power(size / threshold + _EPS)
    return np.array([np.searchsorted(grams, _U(1 << (64 - p))) if p else size for p in range(low, high + 1)], np.int32)


def _universe_keys(own: np.ndarray, p: int) -> np.ndarray:
    """A key is the n-gram's hash mixed with the universe."""
    return textvec.mix64(own + _U(p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(64 - SKETCH_BITS)).astype(np.int64)


def alone(size: int, threshold: float) -> bool:
    """Whether only a set of the same n-grams can be similar."""
    return least_overlap(size, threshold) == size and int(np.floor(size / threshold + _EPS)) == size


def _sparse_blocks(buckets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The counts of the buckets, block by block: gaps between the buckets that occur, then how often each does."""
    at, counts = np.unique(buckets, return_counts=True)
    ends = np.searchsorted(at, np.arange(1, (1 << (SKETCH_BITS - BLOCK_BITS)) + 1) << BLOCK_BITS)
    for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if j > i:
            gaps = np.diff(at[i:j], prepend=k << BLOCK_BITS).astype(np.uint32)
            yield k, zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[i:j].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _dense_block(raws: list[bytes]) -> np.ndarray:
    total = np.zeros(1 << BLOCK_BITS, np.float64)
    for raw in raws:
        both = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 4, -1)
        gaps, counts = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in both)
        total[np.cumsum(gaps, dtype=np.int64)] += counts
    return np.minimum(255, np.round(6 * np.log2(total + 1))).astype(np.uint8)


def _survey(n: int, threshold: float):
    """A row for each document with terms: its set's id and, where the task meets the set first, what is kept of it. Rows of the sketch besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[np.ndarray] = []
        seen: set[bytes] = set()
        types = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in SURVEY.split(", ")]

        def blocks() -> pa.RecordBatch:
            k, raws = zip(*_sparse_blocks(np.concatenate(counted)), strict=True)
            none = [None] * len(k)
            spread = [b"%d" % x for x in k]  # in place of a set's id, so that blocks are spread over tasks
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([spread, *[none] * 7, k, raws], types, strict=True)], names=names)

        for b in batches:
            rows, at, held = [], [], []
            for i, g in enumerate(textvec.row_grams(b.column("text"), n)):
                if not len(g):
                    continue
                at.append(i)
                sid = set_id(g)
                if sid in seen:
                    rows.append((sid, False, len(g), None, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                c = cuts_of(g, threshold)
                own, low = g[: c[0]], power(len(g))
                rows.append((sid, True, len(g), (own >> _U(32)).astype(np.uint32).tobytes(), own.astype(np.uint32).tobytes(), c.tobytes()))
                held += [_universe_keys(own[:upto], low + k) for k, upto in enumerate(c.tolist())]
            if rows:
                sid, fat, size, hi, lo, cuts = zip(*rows, strict=True)
                where, none = pa.array(at), [None] * len(at)
                cols = [sid, fat, b.column("doc_id").take(where), b.column("th").take(where), size, hi, lo, cuts, none, none]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)
            if held:
                counted.append(_buckets(np.concatenate(held)).astype(np.uint32))
            if sum(map(len, counted)) > 8_000_000:
                yield blocks()
                counted.clear()
        if counted:
            yield blocks()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by set id, what is kept first: each set gets a number, and its first row alone has what is kept of it."""
    sno, last = TaskContext.get().partitionId() << 33, None
    names = [x.split()[0] for x in SETS.split(", ")]
    for b in batches:
        if not b.num_rows:
            continue
        sids = b.column("sid")
        own = b.column("block").is_null()
        old = pa.array([last], pa.binary())
        lead = pc.and_(own, pc.not_equal(sids, pa.concat_arrays([old, sids.slice(0, len(sids) - 1)])).fill_null(True))
        last = sids[-1].as_py()
        snos = sno + np.cumsum(lead.to_numpy(zero_copy_only=False))
        sno = int(snos[-1])
        none = pa.nulls(b.num_rows, pa.binary())
        kept = [pc.if_else(lead, b.column(c), none) for c in ("hi", "lo", "cuts")]
        numbers = pc.if_else(own, pa.array(snos), pa.nulls(b.num_rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([numbers, lead, b.column("doc_id"), b.column("th"), b.column("n"), *kept, b.column("block"), b.column("counts")], names=names)


def _sum_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [int(key[0])], "counts": [_dense_block(rows["counts"].tolist()).tobytes()]})


def prefix_keys(kept: np.ndarray, cuts: np.ndarray, size: int, order: np.ndarray, threshold: float) -> np.ndarray:
    """The keys that stand for a set in the matrix: its prefix in each universe where it may meet another set."""
    if alone(size, threshold):
        return np.zeros(0, _U)
    low, parts = power(size), []
    for k, upto in enumerate(cuts.tolist()):
        keys, p = _universe_keys(kept[:upto], low + k), low + k
        t = max(threshold - MARGIN, threshold / 2) if p else threshold
        take = upto - least_overlap(upto, t) + (MATCHES if p else matches(size, threshold))
        if take < upto:
            keys = keys[np.lexsort((keys, order[_buckets(keys)]))[:take]]
        parts.append(keys)
    return np.concatenate(parts)


def _prefixes(threshold: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            keys, lens = [], []
            for size, hi, lo, cuts in zip(*(b.column(c).to_pylist() for c in ("n", "hi", "lo", "cuts")), strict=True):
                kept = (np.frombuffer(hi, np.uint32).astype(_U) << _U(32)) | np.frombuffer(lo, np.uint32).astype(_U)
                keys.append(prefix_keys(kept, np.frombuffer(cuts, np.int32), size, order, threshold))
                lens.append(len(keys[-1]))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column("sno").to_numpy(), lens))], names=["key", "sno"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Rows sorted by the first column, as arrays that never part rows which agree in it."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([b.column(c).to_numpy() for c in columns], axis=1)
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # rows of the last key wait for the next batch
        if last:
            yield np.concatenate([*held, rows[:last]])
            held = []
        elif held and held[0][0, 0] != rows[0, 0]:
            yield np.concatenate(held)
            held = []
        held.append(rows[last:])
    if held:
        yield np.concatenate(held)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sno, df) of the keys that two sets or more have, from (key, sno) sorted by key.

    Keys are numbered from here on, since small numbers take less room in shuffles;
    were two to get one number (16 million in a partition), more groups would be opened, not fewer.
    """
    key = (TaskContext.get().partitionId() & 0x3FFFF) << 24
    for rows in _runs(batches, ("key", "sno")):
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.append(np.flatnonzero(new), len(rows)))
        sizes_of = np.repeat(sizes, sizes)
        snos, df = rows[sizes_of > 1, 1], sizes_of[sizes_of > 1]
        numbers = key + np.repeat(np.arange((sizes > 1).sum()), sizes[sizes > 1])
        key += int((sizes > 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.ascontiguousarray(snos)), pa.array(df, pa.int64())], names=["key", "sno", "df"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, sno, grp) sorted by key: (sno, grp) for each key of the set that the group's union has from another one, groups up to the set's own."""

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.empty(len(rows), dtype=bool)
        new[0] = True
        np.not_equal(rows[1:, 0], rows[:-1, 0], out=new[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        snos, grps, n = [], [], 0
        for s, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            run = rows[s : s + k]
            if k == 2:
                a, b = run
                if a[2] == b[2]:
                    snos.append(run[:, 1])
                    grps.append(run[:, 2])
                    n += 2
                else:
                    snos.append(np.array([a[1] if a[2] > b[2] else b[1]]))
                    grps.append(np.array([min(a[2], b[2])]))
                    n += 1
            else:
                g, c = np.unique(run[:, 2], return_counts=True)
                for i in range(k):
                    upto = int(np.searchsorted(g, run[i, 2]))
                    fit = g[: upto + (c[upto] > 1)]
                    snos.append(np.full(len(fit), run[i, 1]))
                    grps.append(fit)
                    n += len(fit)
            if n > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(snos)), pa.array(np.concatenate(grps))], names=["sno", "grp"])
                snos, grps, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(snos)), pa.array(np.concatenate(grps))], names=["sno", "grp"])

    for rows in _runs(batches, ("key", "sno", "grp")):
        yield from emit(rows)


def _asking(met: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(grp, sno, n) of the groups up to a set's own, by number, whose bound it reaches: enough keys in common with other sets, and a member of a fitting size."""
    matrix = met.select("key", "sno").join(grouped.select("sno", "grp"), "sno").select("key", "sno", "grp")
    hits = matrix.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_overlaps, "sno long, grp long")
    shared = hits.groupBy("sno", "grp").count().join(grouped.select("sno", "n"), "sno").where(F.col("count") >= F.least(F.lit(MATCHES), F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - _EPS))))
    sizes = grouped.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return shared.join(sizes, "grp").where((F.col("most") >= F.col("n") * threshold - _EPS) & (F.col("least") * threshold <= F.col("n") + _EPS)).select("grp", "sno", "n")


def _hits(sets: list[np.ndarray], queries: list[int], members: list[int], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that has any: it, which of the members reach the threshold, and their similarities."""
    if not members or not queries:
        return
    flat = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    uniq, first = np.unique(flat, return_index=True)
    first = np.append(first, len(flat))
    sizes = np.array([len(sets[m]) for m in members])
    for q in queries:
        own = sets[q]
        if not len(own) or not len(uniq):
            continue
        at = np.minimum(np.searchsorted(uniq, own), len(uniq) - 1)
        at = at[uniq[at] == own]
        lens = first[at + 1] - first[at]
        total = int(lens.sum())
        if not total:
            continue
        where = np.repeat(first[at] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)
        common = np.bincount(owner[where], minlength=len(members))
        j = common / (sizes + len(own) - common)
        at = np.flatnonzero(j >= threshold)
        if len(at):
            yield q, at, j[at]


def similar(sets: list[np.ndarray], queries: list[int], members: list[int], allowed, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(query, member, similarity) of all allowed pairs of positions that reach the threshold."""
    for q, at, j in _hits(sets, queries, members, threshold):
        for k, x in zip(at.tolist(), j.tolist(), strict=True):
            if allowed(q, members[k]):
                yield q, members[k], x


def _screen(threshold: float):
    """The sets of a group, and its queries, that have a partner there by their samples: their roles."""

    def run(group: pa.Table) -> pa.Table:
        snos, member, asks, sizes = (group.column(c).to_pylist() for c in ("sno", "member", "asks", "n"))
        raw = [np.frombuffer(x, np.uint32) for x in group.column("lo").to_pylist()]
        cuts = [np.frombuffer(x, np.int32) for x in group.column("cuts").to_pylist()]
        powers = [power(n) for n in sizes]
        roles: dict[int, list[bool]] = {}

        def allowed(q: int, m: int) -> bool:
            return snos[m] != snos[q] and (not member[q] or snos[m] < snos[q]) and max(powers[q], powers[m]) == p and min(sizes[q], sizes[m]) >= threshold * max(sizes[q], sizes[m]) - _EPS

        for p in sorted(set(powers)):
            # a sample starts with that of every higher universe
            here = [i for i in range(len(snos)) if powers[i] <= p < powers[i] + len(cuts[i])]
            sets = {i: np.unique(raw[i][: cuts[i][p - powers[i]]]) for i in here}
            for q, m, _ in similar(sets, [i for i in here if asks[i]], [i for i in here if member[i]], allowed, threshold - (SCREEN if p else 1e-3)):
                roles.setdefault(q, [member[q], False])[1] = True
                roles.setdefault(m, [True, False])
        k, first = len(roles), group.slice(0, 1)
        grp, part = first.column("grp")[0].as_py(), first.column("part")[0].as_py()
        cols = [[grp] * k, [part] * k, [snos[i] for i in roles], [x for x, _ in roles.values()], [x for _, x in roles.values()]]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("grp", "part", "sno", "member", "asks"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)})

    return run


def _forest(found: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """As many of the pairs as keep what is connected connected."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    out = []
    for q, m, j in found:
        a, b = top(q), top(m)
        if a != b:
            root[a] = b
            out.append((q, m, j))
    return out


def count_links(sets: list[np.ndarray], queries: list[int], members: list[int], numbers: np.ndarray, inside: np.ndarray, weights: np.ndarray, odd: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each position's links, as the weights of what it is similar to; as many pairs as keep what is connected connected; all pairs with an odd side. Memory follows the sets, not their pairs."""
    own, links, tree = np.array(members, np.int64), np.zeros(len(sets), np.int64), np.arange(len(sets))
    edges, apart = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for q, at, _ in _hits(sets, queries, members, threshold):
        near = own[at]
        near = near[numbers[near] < numbers[q] if inside[q] else numbers[near] != numbers[q]]
        links[q] += weights[near].sum()
        links[near] += weights[q]
        trees, first = np.unique(tree[near], return_index=True)
        new = trees != tree[q]
        if new.any():
            edges.append(np.stack([np.full(new.sum(), q), near[first[new]]], axis=1))
            tree[np.isin(tree, trees[new])] = tree[q]
        far = near if odd[q] else near[odd[near]]
        apart.append(np.stack([np.full(len(far), q), far], axis=1))
    return links, np.concatenate(edges), np.concatenate(apart)


def _open_links(n: int, threshold: float):
    """As ``_open``, with counts in place of pairs."""

    def run(group: pa.Table) -> pa.Table:
        numbers, inside, weights, odd = (group.column(c).to_numpy() for c in ("sno", "member", "weight", "odd"))
        sets = list(textvec.row_grams(group.column("text").combine_chunks(), n))
        rows = list({s: i for i, s in enumerate(numbers.tolist())}.values())
        asks = group.column("asks").to_pylist()
        links, edges, apart = count_links(sets, [i for i in rows if asks[i]], [i for i in rows if inside[i]], numbers, inside, weights, odd, threshold)
        some = np.flatnonzero(links)
        pairs, k = numbers[np.concatenate([edges, apart])], len(edges) + len(apart)
        cols = [pa.array(np.concatenate([numbers[some], pairs[:, 0]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]))])]
        cols += [pa.concat_arrays([pa.array(links[some]), pa.nulls(k, pa.int64())]), pa.array(np.repeat([False, True], [len(some) + len(edges), len(apart)]))]
        return pa.table(dict(zip(("a", "b", "links", "odd"), cols, strict=True)))

    return run


def _open(n: int, threshold: float, forest: bool):
    def run(group: pa.Table) -> pa.Table:
        snos, docs, member, asks = (group.column(c).to_pylist() for c in ("sno", "doc_id", "member", "asks"))
        sets = list(textvec.row_grams(group.column("text").combine_chunks(), n))
        rows = list({s: i for i, s in enumerate(snos)}.values())  # repeated rows are here once for each
        found = similar(sets, [i for i in rows if asks[i]], [i for i in rows if member[i]], lambda q, m: snos[m] != snos[q] and (not member[q] or snos[m] < snos[q]), threshold)
        found = _forest(found) if forest else list(found)
        cols = [[of[x[side]] for x in found] for of in (snos, docs) for side in (0, 1)]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("a", "b", "doc_a", "doc_b"), cols, strict=True)} | {"jaccard": pa.array([j for *_, j in found], pa.float64())})

    return run


def _weights(members: DataFrame) -> DataFrame:
    """(sno, weight, odd) of sets that stand for other than one document: how many are in no other set, and whether some are."""
    return members.groupBy("sno").agg(F.count(F.when(~F.col("odd"), 1)).alias("weight"), F.max("odd").alias("odd")).where("weight <> 1 or odd")


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, forest: bool = False, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets (a, b, doc_a, doc_b: a document of each; jaccard), and the documents of all sets (sno, doc_id, th, lead: whether it stands for its set).

    th is a hash of the text. With ``forest``, only as many pairs as connect what is similar, in one step or several.
    With ``links``, rows of LINKS in place of pairs, and of the documents (sno, doc_id, odd: whether it is in several sets), each once.
    """
    spark = docs.sparkSession
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    survey = base.mapInArrow(_survey(n, threshold), SURVEY).repartition(F.col("sid")).sortWithinPartitions("sid", F.col("fat").desc())
    made = written(survey.mapInArrow(_numbered, SETS), "sets")
    blocks = made.where("block is not null").groupBy("block").applyInPandas(_sum_blocks, "block int, counts binary").orderBy("block").collect()
    sketch = {r.block: bytes(r.counts) for r in blocks}
    empty = bytes(1 << BLOCK_BITS)
    order = spark.sparkContext.broadcast(b"".join(sketch.get(k, empty) for k in range(1 << (SKETCH_BITS - BLOCK_BITS))))
    each = made.where("sno is not null").select("sno", "doc_id", "th", "lead")
    sets = made.where("lead")

    entries = sets.select("sno", "n", "hi", "lo", "cuts").mapInArrow(_prefixes(threshold, order), "key long, sno long")
    met = written(entries.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_shared_keys, "key long, sno long, df long"), "keys")

    # a group's number falls with the sets that have its key, so a lower one is more popular
    sizes = sets.select("sno", "n")
    best = met.groupBy("sno").agg(F.max(F.struct("df", "key")).alias("b")).select("sno", (-(F.least("b.df", F.lit((1 << 20) - 1)) * (1 << 42) + F.col("b.key"))).alias("grp"))
    first = written(best.join(sizes, "sno"), "first")
    moved = _asking(met, first, threshold).groupBy("sno").agg(F.min("grp").alias("to"))
    named = first.join(moved, "sno", "left").select("sno", "n", F.coalesce("to", "grp").alias("lead"))
    large = named.groupBy("lead").agg(F.ceil(F.sum("n") / GROUP_GRAMS).alias("split")).where("split > 1")
    placed = written(named.join(large, "lead", "left").select("sno", "n", F.when(F.col("split").isNull(), F.col("lead")).otherwise(F.xxhash64("lead", F.pmod(F.xxhash64("sno"), "split"))).alias("grp")), "groups")
    asking = written(_asking(met, placed, threshold), "asking")

    parts = asking.groupBy("grp").agg(F.ceil(F.sum("n") / QUERY_GRAMS).cast("int").alias("parts"))
    inside = placed.select("grp", "sno").join(parts, "grp").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("grp", "part", "sno", F.lit(True).alias("member"), F.lit(False).alias("asks"))
    outside = asking.join(parts, "grp").select("grp", F.pmod(F.xxhash64("sno"), "parts").cast("int").alias("part"), "sno", F.lit(False).alias("member"), F.lit(True).alias("asks"))
    roles = inside.unionByName(outside).groupBy("grp", "part", "sno").agg(F.max("member").alias("member"), F.max("asks").alias("asks"))
    roles = written(roles, "roles")
    # only samples of sets with a role are moved
    left = roles.join(among(sets.select("sno", "n", "lo", "cuts"), roles, "sno"), "sno").groupBy("grp", "part").applyInArrow(_screen(threshold), "grp long, part int, sno long, member boolean, asks boolean")
    # each set's roles go to its text at once, so that the text is moved once by its key and once to its groups
    known = left.groupBy("sno").agg(F.collect_list(F.struct("grp", "part", "member", "asks")).alias("roles")).join(sets.select("sno", "doc_id", "th"), "sno")
    more = []
    if links:
        each = written(each.select("sno", "doc_id").repartition(F.col("doc_id")).dropDuplicates().withColumn("odd", F.count("*").over(Window.partitionBy("doc_id")) > 1), "members")
        known = known.join(_weights(each), "sno", "left").withColumns({"weight": F.coalesce("weight", F.lit(1)), "odd": F.coalesce("odd", F.lit(False))})
        more = ["weight", "odd"]
    wanted = written(known.withColumn("rk", F.xxhash64("doc_id", "th")), "wanted")
    keyed = base.withColumn("rk", F.xxhash64("doc_id", "th"))
    opened = among(keyed, wanted, "rk").join(wanted, ["rk", "doc_id", "th"]).withColumn("r", F.explode("roles")).select("r.grp", "r.part", "sno", "doc_id", "r.member", "r.asks", *more, "text")
    run, given = (_open_links(n, threshold), LINKS) if links else (_open(n, threshold, forest), PAIRS)
    pairs = written(opened.groupBy("grp", "part").applyInArrow(run, given), "pairs")
    drop(met, first, placed, asking, roles, wanted)
    return pairs, each


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """All pairs of documents at the threshold, one row each: doc_a < doc_b, jaccard.

    Copies are paired with each other, and each of them with what its set is
    similar to, so the rows of a group of copies grow with its square.
    """
    pairs, each = similar_sets(docs, n, threshold)
    several_rows = each.where("not lead").select("sno").distinct()
    copies = written(each.join(several_rows, "sno", "left_semi").select("sno", "doc_id").dropDuplicates(), "copies")
    few = copies.count() <= broadcast_copies
    rows = pairs
    for side in ("a", "b"):
        own = copies.select(F.col("sno").alias(side), F.col("doc_id").alias("_copy"))
        rows = rows.join(F.broadcast(own) if few else own, side, "left").withColumn(f"doc_{side}", F.coalesce("_copy", f"doc_{side}")).drop("_copy")
    rows = rows.where("doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    # a part of a set's copies is paired with all of them in one task
    parts = copies.groupBy("sno").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"))
    split = copies.join(parts, "sno")
    first = split.select("sno", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), F.col("doc_id").alias("doc_a"))
    second = split.select("sno", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("doc_id").alias("doc_b"))
    same = first.join(second, ["sno", "part"]).where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    both = rows.unionByName(same)
    several = written(each.select("doc_id", "sno").dropDuplicates().groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return both
    marked = both.join(several.select(F.col("doc_id").alias("doc_a"), F.lit(True).alias("in_a")), "doc_a", "left").join(several.select(F.col("doc_id").alias("doc_b"), F.lit(True).alias("in_b")), "doc_b", "left")
    again = marked.where("in_a or in_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return marked.where("in_a is null and in_b is null").select("doc_a", "doc_b", "jaccard").unionByName(again)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (u, v): the least node of each, by hooking and jumping until nothing changes."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).dropDuplicates(), "edges")
    roots = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("node"), "root"), "roots")
    while True:
        near = both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("near"))
        hooked = roots.join(near, roots.node == near.u, "left").select("node", roots["root"].alias("before"), F.least("root", "near").alias("root"))
        to = roots.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        jumped = hooked.join(to, hooked.root == to["at"], "left").select("node", F.least("root", F.coalesce("beyond", "root")).alias("root"), "before")
        new = written(jumped, "roots")
        drop(roots)
        if new.where("root < before").isEmpty():
            drop(both)
            return new.select("node", "root")
        roots = new


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, keeper, keeper_th) of the texts that are in a group of similar ones, and the one that stays: of the least doc_id, then the least th.

    th is Spark's xxhash64 of the text, so that a doc_id's other texts aren't meant.
    """
    pairs, each = similar_sets(docs, n, threshold, forest=True)
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # sets of one document without a similar one aren't moved
    inside = each.where("not lead").select("sno").unionByName(roots.select(F.col("node").alias("sno"))).distinct()
    own = each.join(inside, "sno", "left_semi").select("sno", "doc_id", "th").dropDuplicates()
    found = written(own.join(roots.withColumnRenamed("node", "sno"), "sno", "left").select("doc_id", "th", F.coalesce("root", "sno").alias("root")), "found")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count("*").alias("c")).where("c > 1")
    return found.join(first, "root").select("doc_id", "th", F.col("k.doc_id").alias("keeper"), F.col("k.th").alias("keeper_th"))


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each doc_id: its class_id, which is the least doc_id of what links connect it with, and links, the number of other documents that reach the threshold with it."""
    found, members = similar_sets(docs, n, threshold, links=True)
    odd = members.where("odd").select("sno", "doc_id")
    some_odd = not odd.isEmpty()
    edges = found.where("b is not null and not odd").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if some_odd:
        edges = edges.unionByName(odd.groupBy("doc_id").agg(F.min("sno").alias("u")).join(odd.withColumnRenamed("sno", "v"), "doc_id").select("u", "v"))
    roots = components(edges)
    weights = _weights(members).select("sno", "weight")
    sums = found.where("b is null").groupBy(F.col("a").alias("sno")).agg(F.sum("links").alias("sum"))
    own = members.join(sums, "sno", "left").join(weights, "sno", "left").join(roots.withColumnRenamed("node", "sno"), "sno", "left")
    own = own.select("sno", "doc_id", (F.coalesce("sum", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("links"), F.coalesce("root", "sno").alias("root"))
    if some_odd:
        # sets that are similar, or the same, of which one has a document of several sets: such documents count once, whatever the sets in which they are met
        pairs = found.where("odd").select(F.col("a").alias("sno"), F.col("b").alias("to"))
        pairs = written(pairs.unionByName(pairs.select(F.col("to").alias("sno"), F.col("sno").alias("to"))).unionByName(odd.select("sno", F.col("sno").alias("to"))).dropDuplicates(), "odd")
        others = odd.select(F.col("sno").alias("to"), F.col("doc_id").alias("other"))
        beside = pairs.join(others, "to").groupBy("sno").agg(F.countDistinct("other").alias("beside"))
        met = odd.join(pairs, "sno").select("doc_id", "to").dropDuplicates()
        single = met.join(weights.withColumnRenamed("sno", "to"), "to", "left").groupBy("doc_id").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("single"))
        of_odd = met.join(others, "to").groupBy("doc_id").agg((F.countDistinct("other") - 1).alias("beside")).join(single, "doc_id").select("doc_id", (F.col("single") + F.col("beside")).alias("all"))
        own = own.join(beside, "sno", "left").join(of_odd, "doc_id", "left").select("doc_id", F.coalesce("all", F.col("links") + F.coalesce("beside", F.lit(0))).alias("links"), "root").dropDuplicates()
    first = own.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    placed = own.join(first, "root").select("doc_id", "class_id", "links")
    # documents without terms have no set
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(placed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document, and its number of links."""
    return linked(table(spark, sf_dir, "documents"))
