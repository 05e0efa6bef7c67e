"""Ratcliff-Obershelp similarity of many pairs of texts at once, in numpy.

The result is ``difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()``: the longest common block (of equals the
first in ``a``, then the first in ``b``), then those to the left and to the right of it. All pairs take a step together,
and a pair is left as soon as no more characters can match than its least ratio needs.
"""

from __future__ import annotations

import numpy as np

#: Pairs that go together; cells of a table, and columns that it takes whatever their lengths; characters that are counted at once, and by how many kinds (fewer only bound less).
PAIRS, CELLS, COLUMNS, CHARS, WIDTH = 1 << 17, 1 << 18, 64, 1 << 21, 64


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each begins (and the last one ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span of n places."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _counts(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(n)) * WIDTH, n)
    return np.bincount(own + x[_spans(start, n)] % WIDTH, minlength=len(n) * WIDTH).reshape(-1, WIDTH)


def _common(a, a0, na, b, b0, nb) -> np.ndarray:
    """Characters that the parts of each pair have in common, wherever they stand."""
    out = np.zeros(len(a0), np.int64)
    for own in _cut(na + nb, CHARS):
        out[own] = np.minimum(_counts(a, a0[own], na[own]), _counts(b, b0[own], nb[own])).sum(axis=1)
    return out


def _cut(size: np.ndarray, most: int) -> list[slice]:
    """Slices of about ``most``, or of one that is larger."""
    ends = np.cumsum(size)
    at = np.unique(np.r_[0, np.searchsorted(ends, np.arange(most, int(ends[-1]), most), side="left"), len(size)]) if len(size) else []
    return [slice(int(s), int(e)) for s, e in zip(at[:-1], at[1:], strict=True)]


def _padded(x: np.ndarray, start: np.ndarray, n: np.ndarray, fill: int) -> np.ndarray:
    """The spans as columns, filled up below."""
    at = np.arange(int(n.max()))[:, None]
    return np.where(at < n, x[np.minimum(start + at, len(x) - 1)], x.dtype.type(fill))


def _longest(a, a0, na, b, b0, nb, fills) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, place in the part of ``a`` and place in the part of ``b`` of each pair's longest common block."""
    k, i, j = (np.zeros(len(a0), np.int64) for _ in range(3))
    # pairs of about equal lengths share a table, so that it has little to fill up
    group = np.ceil(4 * np.log2(na)).astype(np.int64)
    order = np.lexsort((nb, group))
    group, size, at = group[order], nb[order], 0
    while at < len(order):
        last = int(np.searchsorted(group, group[at], side="right"))
        end = min(last, max(at + COLUMNS, at + int(np.searchsorted(size[at:last], 1.2 * size[at], side="right"))))
        end = min(end, at + max(1, CELLS // int(size[end - 1] + 1)))
        own, at = order[at:end], end
        k[own], i[own], j[own] = _table(_padded(a, a0[own], na[own], fills[0]), _padded(b, b0[own], nb[own], fills[1]))
    return k, i, j


def _table(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common block of each column of ``left`` and the same of ``right``."""
    kind = np.uint8 if min(len(left), len(right)) < 256 else np.uint32
    run = np.zeros((len(right) + 1, left.shape[1]), kind)
    more, same, one = np.empty(right.shape, kind), np.empty(right.shape, bool), kind(1)
    best, bi, bj = np.zeros(left.shape[1], kind), np.zeros(left.shape[1], np.int64), np.zeros(left.shape[1], np.int64)
    for t, row in enumerate(left):
        np.equal(right, row, out=same)
        np.add(run[:-1], one, out=more)
        np.multiply(more, same.view(np.uint8), out=run[1:])
        most = run.max(axis=0)
        up = np.flatnonzero(most > best)
        if len(up):
            best[up] = most[up]
            bi[up] = t + 1 - most[up].astype(np.int64)
            bj[up] = run[:, up].argmax(axis=0) - most[up].astype(np.int64)
    return best, bi, bj


def ratios(a: np.ndarray, a0: np.ndarray, na: np.ndarray, b: np.ndarray, b0: np.ndarray, nb: np.ndarray, least: float | np.ndarray = 0.0) -> np.ndarray:
    """The ratio of each pair of a part of ``a`` and a part of ``b`` (where they begin, their lengths), or -1 where it is below ``least``."""
    known = np.unique(a)
    # characters that ``a`` hasn't are one code; two more fill up the tables
    fills = len(known) + 1, len(known) + 2
    code = np.full(0x110000, len(known), np.uint8 if fills[1] < 256 else np.uint32)
    code[known] = np.arange(len(known))
    a, b = code[a], code[b]
    out = np.empty(len(a0))
    least = np.broadcast_to(np.asarray(least, float), len(a0))
    for s in range(0, len(a0), PAIRS):
        own = slice(s, s + PAIRS)
        out[own] = _part(a, a0[own], na[own], b, b0[own], nb[own], least[own], fills)
    return out


def _part(a, a0, na, b, b0, nb, least, fills) -> np.ndarray:
    total, got, dead = na + nb, np.zeros(len(a0), np.int64), np.zeros(len(a0), bool)
    whole = np.maximum(total, 1)
    own, s, n, u, m = np.arange(len(a0)), a0, na, b0, nb
    while len(own):
        can = _common(a, s, n, b, u, m)
        dead |= 2.0 * (got + np.bincount(own, can, len(a0))) / whole < least
        stay = np.flatnonzero(~dead[own] & (can > 0))
        own, s, n, u, m = own[stay], s[stay], n[stay], u[stay], m[stay]
        k, i, j = _longest(a, s, n, b, u, m, fills)
        np.add.at(got, own, k)
        own, s, n, u, m = np.tile(own, 2), np.r_[s, s + i + k], np.r_[i, n - i - k], np.r_[u, u + j + k], np.r_[j, m - j - k]
        stay = np.flatnonzero((np.tile(k, 2) > 0) & (n > 0) & (m > 0))
        own, s, n, u, m = own[stay], s[stay], n[stay], u[stay], m[stay]
    out = np.where(total > 0, 2.0 * got / whole, 1.0)
    return np.where((dead & (total > 0)) | (out < least), -1.0, out)
