"""Vectorised work on the UTF-8 bytes of an Arrow text column: terms, hashes, n-grams.

A term is a maximal run of characters other than ASCII non-alphanumerics, after
lower-casing (``TERM_PATTERN`` says the same as a regular expression). A null
text counts as empty and has no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TERM_PATTERN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True

#: Bytes of text that one numpy pass handles, so that temporaries stay near 100 bytes per byte of this.
SLICE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, SLICE_BYTES + 1), base, dtype=_U)
        a[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(a, dtype=_U)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and bytes of a text column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def lower(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(arr)


def pieces(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def term_spans(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each term among the bytes, and how many terms each row has."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    w = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial hash."""
    with np.errstate(over="ignore"):
        p = np.empty(len(data) + 1, _U)
        p[0] = 0
        np.cumsum(_BYTE[data] * _power(_R, len(data)), out=p[1:])
        h = (p[ends] - p[starts]) * _power(_RINV, len(data) + 1)[starts]
        h += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix64(h)


def grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` terms within each row, and how many each row has.

    A row of fewer than ``n`` terms has one gram, of all of them; a row of none has none.
    """
    if n == 1:
        return hashes, counts
    ends = np.cumsum(counts)
    out = np.zeros(len(hashes), _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[: len(hashes) - k] = (out[: len(hashes) - k] + hashes[k:]) * _U(0xD1342543DE82EF95 + 2 * k)
    keep = np.ones(len(hashes), dtype=bool)
    for k in range(1, n):
        at = ends - k
        keep[at[counts >= k]] = False
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short:
        a, b = int(ends[i] - counts[i]), int(ends[i])
        h = b - a
        for x in hashes[a:b].tolist():
            h = (h * 0xD1342543DE82EF95 + x + 1) & 0xFFFFFFFFFFFFFFFF
        out[a] = h
        keep[a] = True
    return mix64(out[keep]), np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))


def row_grams(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row, its distinct n-gram hashes in ascending order. Only a slice of the column is lowered and cut up at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offs, _ = utf8(texts)
    for i, j in pieces(offs):
        o, d = utf8(lower(texts.slice(i, j - i)))
        starts, ends, counts = term_spans(o, d)
        g, gc = grams(span_hashes(d, starts, ends), counts, n)
        at = 0
        for c in gc.tolist():
            yield np.unique(g[at : at + c])
            at += c
    # what the column's slices took goes back to the system, not to the pool
    pa.default_memory_pool().release_unused()
