"""Lossless WebP images as columns of pixels.

``decode`` reads the VP8L bit stream: prefix codes (simple and normal, in groups
chosen by an entropy image), back-references with the two-dimensional distance
map, and the colour cache; then it inverts the predictor, cross-colour,
subtract-green and palette transforms, in the reverse of their order.
``encode`` writes streams that use any of these, to make images for tests and
from tables. Pixels are 0xAARRGGBB, row by row.

Pixels are held in arrays of four bytes each; an image of more than ``MAX_PIXELS``
(a header can claim 2^28) is an error before anything is allocated for it.

Edges of ``decode_column``: a null image, one that is damaged, cut short, too large or not
lossless WebP has null width, height and pixels, and its error in ``error``;
rows that repeat are decoded alike; other columns are carried, save those named
like an output column.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.shared import table

MADE = ["width", "height", "pixels", "error"]
#: Pixels of one image; of a batch that is handed on at once.
MAX_PIXELS, BATCH_PIXELS = 1 << 25, 1 << 22
#: Pixels from which a stretch of one predictor is worth an array operation.
STRETCH = 48
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _distance_map() -> list[tuple[int, int]]:
    near = "01 10 11 -11 02 20 12 -12 21 -21 22 -22 03 30 13 -13 31 -31 23 -23 32 -32 04 40 14 -14 41 -41 33 -33 24 -24 42 -42 05 34 -34 43 -43 50 15 -15 51 -51 25 -25 52 -52 44 -44 35 -35 53 -53 06 60 16 -16 61 -61 26 -26 62 -62 45 -45 54 -54 36 -36 63 -63 07 70 17 -17 55 -55 71 -71 46 -46 64 -64 27 -27 72 -72 37 -37 73 -73 56 -56 65 -65 80 47 -47 74 -74 81 82 66 -66 83 57 -57 75 -75 84 67 -67 76 -76 85 77 -77 86 87"
    return [(int(x[:-1]), int(x[-1])) for x in near.split()]


_NEAR = _distance_map()


class _Bits:
    """Reads bits, lowest first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.hold, self.n, self.over = raw, 0, 0, 0, 0

    def fill(self) -> None:
        part = self.raw[self.at : self.at + 8]
        self.at += 8
        if not part:
            self.over += 64
            if self.over > 128:
                raise ValueError("the image is cut short")
        self.hold |= int.from_bytes(part, "little") << self.n
        self.n += 64

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill()
        x = self.hold & ((1 << n) - 1)
        self.hold >>= n
        self.n -= n
        return x


class _Code:
    """A prefix code's look-up table: bits of the longest code -> length | symbol << 4."""

    def __init__(self, lengths: list[int]):
        used = sorted((x, s) for s, x in enumerate(lengths) if x)
        if len(used) < 2:
            self.width, self.table = 0, [used[0][1] << 4 if used else 0]
            return
        self.width = w = used[-1][0]
        size = 1 << w
        self.table = table = [0] * size
        code, last, room = 0, used[0][0], size
        for x, s in used:
            code <<= x - last
            last = x
            room -= size >> x
            if room < 0:
                raise ValueError("a prefix code is over-full")
            back = int(f"{code:0{x}b}"[::-1], 2)
            table[back :: 1 << x] = [x | s << 4] * (size >> x)
            code += 1
        if room:
            raise ValueError("a prefix code is incomplete")

    @staticmethod
    def single(symbols: list[int]) -> _Code:
        c = _Code([])
        if len(symbols) == 1:
            c.table = [symbols[0] << 4]
        else:
            c.width, c.table = 1, [1 | symbols[0] << 4, 1 | symbols[1] << 4]
        return c

    def read(self, b: _Bits) -> int:
        w = self.width
        if b.n < w:
            b.fill()
        e = self.table[b.hold & ((1 << w) - 1)]
        b.hold >>= e & 15
        b.n -= e & 15
        return e >> 4


def _read_code(b: _Bits, size: int) -> _Code:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)]
        if two:
            symbols.append(b.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol is outside its alphabet")
        return _Code.single(symbols)
    first = [0] * 19
    for k in range(4 + b.read(4)):
        first[_LENGTH_ORDER[k]] = b.read(3)
    code = _Code(first)
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    lengths, last = [], 8
    while len(lengths) < size and most:
        most -= 1
        s = code.read(b)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + b.read(2))
        else:
            lengths += [0] * (3 + b.read(3) if s == 17 else 11 + b.read(7))
    if len(lengths) > size:
        raise ValueError("code lengths overrun their alphabet")
    return _Code(lengths)


def _prefixed(b: _Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + b.read(extra) + 1


def _read_image(b: _Bits, w: int, h: int, main: bool = False) -> np.ndarray:
    """The pixels of an entropy-coded image, as a flat uint32 array."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    tile, groups_of, n_groups, tw = 14, None, 1, 1
    if main and b.read(1):
        tile = b.read(3) + 2
        tw, th = (w + (1 << tile) - 1) >> tile, (h + (1 << tile) - 1) >> tile
        groups_of = ((_read_image(b, tw, th) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
        n_groups = max(groups_of) + 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = []
    for _ in range(n_groups):
        g, r, bl, al, d = (_read_code(b, n) for n in sizes)
        # where red, blue and alpha are one symbol each, a pixel is its green and this
        fixed = -1 if r.width or bl.width or al.width else (al.table[0] >> 4) << 24 | (r.table[0] >> 4) << 16 | bl.table[0] >> 4
        groups.append(((1 << g.width) - 1, g.table, (1 << r.width) - 1, r.table, (1 << bl.width) - 1, bl.table, (1 << al.width) - 1, al.table, d, fixed))
    total, side = w * h, 1 << tile
    out = array("I", bytes(4 * total))
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    at, cached, end = 0, 0, 0
    raw, pos, hold, n = b.raw, b.at, b.hold, b.n
    limit = len(raw) + 16
    gm = rm = bm = am = 0
    gt = rt = bt = alt = distance = None
    fixed = -1
    while at < total:
        if at >= end:  # the next stretch of one group: the rest of the image, or of a row of a tile
            if groups_of is None:
                gm, gt, rm, rt, bm, bt, am, alt, distance, fixed = groups[0]
                end = total
            else:
                y, x = divmod(at, w)
                gm, gt, rm, rt, bm, bt, am, alt, distance, fixed = groups[groups_of[(y >> tile) * tw + (x >> tile)]]
                end = at + min(side - x % side, w - x)
            if not gm and fixed >= 0 and gt[0] >> 4 < 256:
                out[at:end] = array("I", [fixed | gt[0] >> 4 << 8]) * (end - at)
                at = end
                continue
        if n < 64:
            if pos >= limit:
                raise ValueError("the image is cut short")
            hold |= int.from_bytes(raw[pos : pos + 8], "little") << n
            pos += 8
            n += 64
        e = gt[hold & gm]
        hold >>= e & 15
        n -= e & 15
        s = e >> 4
        if s < 256:
            if fixed >= 0:
                out[at] = fixed | s << 8
            else:
                e = rt[hold & rm]
                k = e & 15
                f = bt[hold >> k & bm]
                k += f & 15
                q = alt[hold >> k & am]
                k += q & 15
                hold >>= k
                n -= k
                out[at] = (q >> 4) << 24 | (e >> 4) << 16 | s << 8 | f >> 4
            at += 1
        elif s < 280:
            b.at, b.hold, b.n = pos, hold, n
            size = _prefixed(b, s - 256)
            d = _prefixed(b, distance.read(b))
            pos, hold, n = b.at, b.hold, b.n
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * w)
            if d > at or at + size > total:
                raise ValueError("a back-reference leaves the image")
            if d >= size:
                out[at : at + size] = out[at - d : at - d + size]
            else:
                out[at : at + size] = (out[at - d : at] * (size // d + 1))[:size]
            at += size
        else:
            # pixels enter the cache no earlier than it is read
            for p in out[cached:at]:
                cache[((0x1E35A7BD * p) & 0xFFFFFFFF) >> shift] = p
            cached = at
            out[at] = cache[s - 280]
            at += 1
    if 8 * pos - n > 8 * len(raw):
        raise ValueError("the image is cut short")
    b.at, b.hold, b.n = pos, hold, n
    return np.frombuffer(out, np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    """Pixels as int32 channels (alpha, red, green, blue) on the last axis."""
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _merge(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _half(a: int, b: int) -> int:
    x = a - b
    x = a + (x // 2 if x >= 0 else -(-x // 2))
    return 0 if x < 0 else 255 if x > 255 else x


def _avg(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamped(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left, top, right, corner):
    """The prediction from the four known neighbours (left, top, top right, top left), as channels."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _avg(_avg(left, right), top)
    if mode == 6:
        return _avg(left, corner)
    if mode == 7:
        return _avg(left, top)
    if mode == 8:
        return _avg(corner, top)
    if mode == 9:
        return _avg(top, right)
    if mode == 10:
        return _avg(_avg(left, corner), _avg(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamped(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [_half(a, c) for a, c in zip(_avg(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _residuals(known, w: int, h: int, modes, tile: int):
    """Pixels, as channels, to residuals."""
    tw = (w + (1 << tile) - 1) >> tile
    out = []
    for i in range(w * h):
        y, x = divmod(i, w)
        if not y:
            p = known[i - 1] if x else (255, 0, 0, 0)
        elif not x:
            p = known[i - w]
        else:
            p = predict(modes[(y >> tile) * tw + (x >> tile)], known[i - 1], known[i - w], known[i - w + 1], known[i - w - 1])
        v = known[i]
        out.append([(v[0] - p[0]) & 255, (v[1] - p[1]) & 255, (v[2] - p[2]) & 255, (v[3] - p[3]) & 255])
    return out


def _plus(a: int, b: int) -> int:
    """The sum of two pixels, channel by channel."""
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _select(left: int, top: int, corner: int) -> int:
    by = 0  # what the prediction differs by from left, less what it differs by from top
    for s in (0, 8, 16, 24):
        x, t, c = left >> s & 255, top >> s & 255, corner >> s & 255
        by += abs(t - c) - abs(x - c)
    return left if by < 0 else top


def _added(left: int, top: int, corner: int) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        x = (left >> s & 255) + (top >> s & 255) - (corner >> s & 255)
        out |= (0 if x < 0 else 255 if x > 255 else x) << s
    return out


def _half_added(a: int, b: int) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        p, q = a >> s & 255, b >> s & 255
        x = p + int((p - q) / 2)
        out |= (0 if x < 0 else 255 if x > 255 else x) << s
    return out


_BY_PIXEL = {
    1: lambda x, t, r, c: x, 2: lambda x, t, r, c: t, 3: lambda x, t, r, c: r, 4: lambda x, t, r, c: c, 5: lambda x, t, r, c: _mean(_mean(x, r), t), 6: lambda x, t, r, c: _mean(x, c), 7: lambda x, t, r, c: _mean(x, t),
    8: lambda x, t, r, c: _mean(c, t), 9: lambda x, t, r, c: _mean(t, r), 10: lambda x, t, r, c: _mean(_mean(x, c), _mean(t, r)), 11: lambda x, t, r, c: _select(x, t, c), 12: lambda x, t, r, c: _added(x, t, c), 13: lambda x, t, r, c: _half_added(_mean(x, t), c),
}
_BLACK = 0xFF000000


def _stretch(mode: int, res: np.ndarray, above: np.ndarray, x: int, e: int, left: int) -> np.ndarray | None:
    """Pixels x .. e-1 of a row whose mode needs no left neighbour, or only sums it up; None for the others. ``above`` has one pixel more than the row."""
    u = res.view(np.uint8).reshape(-1, 4)
    if mode == 1:
        return (np.cumsum(u, axis=0, dtype=np.uint64) + np.array([left], np.uint32).view(np.uint8)).astype(np.uint8).view(np.uint32).ravel()
    if mode in (0, 14, 15):
        by = np.uint32(_BLACK)
    elif mode in (2, 3, 4):
        by = above[x:e] if mode == 2 else above[x + 1 : e + 1] if mode == 3 else above[x - 1 : e - 1]
    elif mode in (8, 9):
        a, b = above[x:e], above[x - 1 : e - 1] if mode == 8 else above[x + 1 : e + 1]
        by = (((a ^ b) & np.uint32(0xFEFEFEFE)) >> np.uint32(1)) + (a & b)
    else:
        return None
    return (u + np.ascontiguousarray(np.broadcast_to(by, res.shape)).view(np.uint8).reshape(-1, 4)).astype(np.uint8).view(np.uint32).ravel()


def _unpredicted(res: np.ndarray, w: int, h: int, modes: list[int], tile: int) -> np.ndarray:
    """Residuals to pixels, row by row: long stretches of a mode that allows it at once, the others pixel by pixel."""
    tw, side = (w + (1 << tile) - 1) >> tile, 1 << tile
    out = np.empty((h, w), np.uint32)
    res = np.ascontiguousarray(res.reshape(h, w))
    first = res[0].view(np.uint8).reshape(-1, 4).astype(np.uint64)
    first[0] += np.array([_BLACK], np.uint32).view(np.uint8)
    out[0] = np.cumsum(first, axis=0).astype(np.uint8).view(np.uint32).ravel()
    above = np.empty(w + 1, np.uint32)
    for y in range(1, h):
        above[:w] = out[y - 1]
        row = modes[(y >> tile) * tw : (y >> tile) * tw + tw]
        left = _plus(int(res[y, 0]), int(above[0]))
        out[y, 0] = left
        above[w] = left  # right of the last pixel above stands this row's first
        x = 1
        while x < w:
            mode, e = row[x >> tile], min(w, (x | (side - 1)) + 1)
            while e < w and row[e >> tile] == mode:
                e = min(w, e + side)
            made = _stretch(mode, res[y, x:e], above, x, e, left) if e - x >= STRETCH else None
            if made is not None:
                out[y, x:e] = made
                left = int(made[-1])
            else:
                by, pixels = _BY_PIXEL.get(mode), []
                up = above[x - 1 : e + 1].tolist()
                for i, v in enumerate(res[y, x:e].tolist()):
                    p = by(left, up[i + 1], up[i + 2], up[i]) if by else _BLACK
                    left = (((v & 0xFF00FF00) + (p & 0xFF00FF00)) & 0xFF00FF00) | (((v & 0x00FF00FF) + (p & 0x00FF00FF)) & 0x00FF00FF)
                    pixels.append(left)
                out[y, x:e] = pixels
            x = e
    return out.ravel()


def _signed8(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(c: np.ndarray, w: int, h: int, elements: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    tw = (w + (1 << tile) - 1) >> tile
    ys, xs = np.divmod(np.arange(w * h), w)
    e = _signed8(_split(elements)[(ys >> tile) * tw + (xs >> tile)])
    to_red, green_blue, red_blue = e[:, 3], e[:, 2], e[:, 1]
    c = c.copy()
    g = _signed8(c[:, 2])
    if inverse:
        c[:, 1] = (c[:, 1] + ((to_red * g) >> 5)) & 255
        c[:, 3] = (c[:, 3] + ((green_blue * g) >> 5) + ((red_blue * _signed8(c[:, 1])) >> 5)) & 255
    else:
        c[:, 3] = (c[:, 3] - ((green_blue * g) >> 5) - ((red_blue * _signed8(c[:, 1])) >> 5)) & 255
        c[:, 1] = (c[:, 1] - ((to_red * g) >> 5)) & 255
    return c


def _pack_bits(colours: int) -> int:
    """log2 of the palette indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(raw: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """The pixels of a lossless WebP file, height x width, as 0xAARRGGBB. ValueError if it isn't one, or has more than ``max_pixels``."""
    if len(raw) < 25 or raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while raw[at : at + 4] != b"VP8L":
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
        if at + 8 > len(raw):
            raise ValueError("no lossless image")
    size = int.from_bytes(raw[at + 4 : at + 8], "little")
    if len(raw) < at + 8 + size:
        raise ValueError("the image is cut short")
    b = _Bits(raw[at + 8 : at + 8 + size])
    if b.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, h = b.read(14) + 1, b.read(14) + 1
    if width * h > max_pixels:
        raise ValueError(f"the image has {width * h} pixels, more than {max_pixels}")
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    w, transforms = width, []
    while b.read(1):
        kind = b.read(2)
        if any(t[0] == kind for t in transforms):
            raise ValueError("a transform is there twice")
        if kind in (0, 1):
            tile = b.read(3) + 2
            sub = _read_image(b, (w + (1 << tile) - 1) >> tile, (h + (1 << tile) - 1) >> tile)
            transforms.append((kind, w, tile, sub))
        elif kind == 2:
            transforms.append((kind, w, 0, None))
        else:
            n = b.read(8) + 1
            palette = _merge(np.cumsum(_split(_read_image(b, n, 1)), axis=0))
            transforms.append((kind, w, _pack_bits(n), palette))
            w = (w + (1 << _pack_bits(n)) - 1) >> _pack_bits(n)
    pixels = _read_image(b, w, h, main=True)
    for kind, tw, bits, sub in reversed(transforms):
        if kind == 0:
            modes = ((sub >> np.uint32(8)) & np.uint32(15)).tolist()
            pixels = _unpredicted(pixels, tw, h, modes, bits)
        elif kind == 1:
            pixels = _merge(_cross(_split(pixels), tw, h, sub, bits, True))
        elif kind == 2:
            c = _split(pixels)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            pixels = _merge(c)
        else:
            index = (pixels >> np.uint32(8)) & np.uint32(255)
            if bits:
                each = 8 >> bits
                rows = index.reshape(h, -1)
                parts = [(rows >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(1 << bits)]
                index = np.stack(parts, axis=-1).reshape(h, -1)[:, :tw].ravel()
            full = np.zeros(256, np.uint32)
            full[: len(sub)] = sub
            pixels = full[index]
    return pixels.reshape(h, width)


class _Out:
    def __init__(self):
        self.hold, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.hold |= x << self.n
        self.n += n

    def done(self) -> bytes:
        return self.hold.to_bytes((self.n + 7) // 8, "little")


def code_lengths(freq: list[int], limit: int) -> list[int]:
    """Huffman code lengths of at most ``limit`` bits; rare symbols are counted up until they fit."""
    used = [s for s, f in enumerate(freq) if f]
    lengths = [0] * len(freq)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(freq[s], floor), k, [s]) for k, s in enumerate(used)]
        heapq.heapify(heap)
        for s in used:
            lengths[s] = 0
        k = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(lengths) <= limit:
            return lengths
        floor *= 2


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = sorted((x, s) for s, x in enumerate(lengths) if x)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    code, last, out = 0, 0, {}
    for x, s in used:
        code <<= x - last
        last = x
        out[s] = (int(f"{code:0{x}b}"[::-1], 2), x)
        code += 1
    return out


def _write_code(o: _Out, freq: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, f in enumerate(freq) if f]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        o.put(1, 1)
        o.put(len(used) - 1, 1)
        wide = used[0] > 1
        o.put(wide, 1)
        o.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            o.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    lengths = code_lengths(freq, 15)
    o.put(0, 1)
    tokens, k = [], 0
    while k < len(lengths):
        x, run = lengths[k], 1
        while k + run < len(lengths) and lengths[k + run] == x and run < (138 if not x else 7):
            run += 1
        if not x and run >= 3:
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif x and run >= 4:
            tokens += [(x, 0, 0), (16, run - 4, 2)]
        else:
            run = 1
            tokens.append((x, 0, 0))
        k += run
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    first = code_lengths(counts, 7)
    n = max(4, 1 + max(k for k, s in enumerate(_LENGTH_ORDER) if first[s]))
    o.put(n - 4, 4)
    for s in _LENGTH_ORDER[:n]:
        o.put(first[s], 3)
    o.put(0, 1)
    codes = _codes(first)
    for t, extra, bits in tokens:
        o.put(*codes[t])
        o.put(extra, bits)
    return _codes(lengths)


def _to_prefix(x: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their value of a length or distance code (1 or more)."""
    if x <= 4:
        return x - 1, 0, 0
    x -= 1
    high = x.bit_length() - 1
    half = (x >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + half, extra, x - ((2 + half) << extra)


def _write_image(o: _Out, pixels: list[int], w: int, cache_bits: int = 0, lz77: bool = False, main: bool = False, tile: int | None = None) -> None:
    o.put(1 if cache_bits else 0, 1)
    if cache_bits:
        o.put(cache_bits, 4)
    near = {}
    for k, (dx, dy) in enumerate(_NEAR):
        near.setdefault(max(1, dx + dy * w), k + 1)
    tokens, seen, cache = [], {}, {}
    i, n = 0, len(pixels)

    def enter(p: int) -> None:
        if cache_bits:
            cache[((0x1E35A7BD * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while i < n:
        p = pixels[i]
        length = 0
        if lz77 and i + 3 <= n:
            j = seen.get(tuple(pixels[i : i + 3]))
            if j is not None:
                while i + length < n and length < 4096 and pixels[j + length] == pixels[i + length]:
                    length += 1
            seen[tuple(pixels[i : i + 3])] = i
        if length >= 3:
            tokens.append((i, "copy", length, i - j))
            for q in pixels[i : i + length]:
                enter(q)
            i += length
            continue
        slot = ((0x1E35A7BD * p) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        tokens.append((i, "cache", slot, 0) if cache_bits and cache.get(slot) == p else (i, "pixel", p, 0))
        enter(p)
        i += 1
    groups = 1
    if main:
        o.put(tile is not None, 1)
        if tile is not None:
            tw, th = (w + (1 << tile) - 1) >> tile, (n // w + (1 << tile) - 1) >> tile
            o.put(tile - 2, 3)
            groups = min(tw * th, 300)
            _write_image(o, [0xFF000000 | (k % groups) << 8 for k in range(tw * th)], tw)

    def group(i: int) -> int:
        return 0 if groups == 1 else ((i // w >> tile) * tw + (i % w >> tile)) % groups

    freq = [[[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40] for _ in range(groups)]
    plan = []
    for i, kind, a, d in tokens:
        g = group(i)
        if kind == "pixel":
            symbols = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
            extras = [(0, 0)] * 4
        elif kind == "cache":
            symbols, extras = [(0, 280 + a)], [(0, 0)]
        else:
            s, x, v = _to_prefix(a)
            t, y, u = _to_prefix(near.get(d, d + 120))
            symbols, extras = [(0, 256 + s), (4, t)], [(v, x), (u, y)]
        plan.append((g, symbols, extras))
        for k, s in symbols:
            freq[g][k][s] += 1
    codes = [[_write_code(o, f) for f in fs] for fs in freq]
    for g, symbols, extras in plan:
        for (k, s), (v, x) in zip(symbols, extras, strict=True):
            o.put(*codes[g][k][s])
            o.put(v, x)


def encode(image: np.ndarray, predictor: int | list[int] | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, lz77: bool = False, tile: int | None = None, sub_tile: int = 2) -> bytes:
    """A lossless WebP file of ``image`` (height x width, 0xAARRGGBB) with the given transforms and codes.

    ``predictor``: one mode, or modes taken in turn by tile. ``cross``: the multipliers (green to red, green to blue, red to blue).
    ``tile``: log2 of the side of the tiles that have prefix codes of their own.
    """
    h, w = image.shape
    width, pixels = w, image.astype(np.uint32).ravel()
    o = _Out()
    o.put(0x2F, 8)
    o.put(w - 1, 14)
    o.put(h - 1, 14)
    o.put(1, 1)
    o.put(0, 3)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        o.put(1 | 3 << 1, 3)
        o.put(len(colours) - 1, 8)
        c = _split(colours)
        _write_image(o, _merge(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32))).tolist(), len(colours))
        bits = _pack_bits(len(colours))
        each = 8 >> bits
        w = (width + (1 << bits) - 1) >> bits
        rows = np.zeros((h, w << bits), np.uint32)
        rows[:, :width] = index.reshape(h, width)
        rows = rows.reshape(h, w, 1 << bits)
        packed = sum(rows[:, :, k] << np.uint32(k * each) for k in range(1 << bits)).ravel()
        pixels = np.uint32(0xFF000000) | packed.astype(np.uint32) << np.uint32(8)
    if green:
        o.put(1 | 2 << 1, 3)
        c = _split(pixels)
        c[:, 1] -= c[:, 2]
        c[:, 3] -= c[:, 2]
        pixels = _merge(c)
    tw, th = (w + (1 << sub_tile) - 1) >> sub_tile, (h + (1 << sub_tile) - 1) >> sub_tile
    if predictor is not None:
        turn = predictor if isinstance(predictor, list) else [predictor]
        modes = [turn[k % len(turn)] for k in range(tw * th)]
        o.put(1, 3)
        o.put(sub_tile - 2, 3)
        _write_image(o, [0xFF000000 | m << 8 for m in modes], tw)
        c = _split(pixels).tolist()
        pixels = _merge(np.array(_residuals(c, w, h, modes, sub_tile), dtype=np.int32))
    if cross is not None:
        o.put(1 | 1 << 1, 3)
        o.put(sub_tile - 2, 3)
        element = 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | (cross[0] & 255)
        elements = np.full(tw * th, element, np.uint32)
        _write_image(o, elements.tolist(), tw)
        pixels = _merge(_cross(_split(pixels), w, h, elements, sub_tile, False))
    o.put(0, 1)
    _write_image(o, pixels.tolist(), w, cache_bits, lz77, True, tile)
    body = o.done()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def decode_column(images: DataFrame, column: str = "image", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """``images`` with width, height, pixels (row by row) and error in place of the image column."""
    columns = [c for c in images.columns if c not in (*MADE, column)]

    def made(b: pa.RecordBatch, i: int, rows: list) -> pa.RecordBatch:
        wide, high, pixels, errors = zip(*rows, strict=True)
        offs = pa.array(np.concatenate([[0], np.cumsum([0 if p is None else p.size for p in pixels])]).astype(np.int32))
        flat = np.concatenate([p.ravel() for p in pixels if p is not None] or [np.zeros(0, np.uint32)]).astype(np.int64)
        lists = pa.ListArray.from_arrays(offs, pa.array(flat), mask=pa.array([p is None for p in pixels]))
        part = b.slice(i, len(rows))
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(wide, pa.int32()), pa.array(high, pa.int32()), lists, pa.array(errors, pa.string())], names=[*columns, *MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, size = [], 0, 0
            for i, raw in enumerate(b.column(column)):
                try:
                    if not raw.is_valid:
                        raise ValueError("no image")
                    p = decode(raw.as_py(), max_pixels)
                    rows.append((p.shape[1], p.shape[0], p, None))
                    size += p.size
                except (ValueError, IndexError, TypeError, MemoryError) as e:
                    rows.append((None, None, None, str(e) or type(e).__name__))
                if size > BATCH_PIXELS:
                    yield made(b, at, rows)
                    rows, at, size = [], i + 1, 0
            if rows:
                yield made(b, at, rows)

    types = [T.IntegerType(), T.IntegerType(), T.ArrayType(T.LongType()), T.StringType()]
    schema = T.StructType([images.schema[c] for c in columns] + [T.StructField(n, t) for n, t in zip(MADE, types, strict=True)])
    return images.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{column}`")).mapInArrow(run, schema)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ways = [dict(predictor=list(range(14)), cross=(5, -9, 17), green=True), dict(palette=True, cache_bits=4), dict(lz77=True, cache_bits=6, tile=2), dict(green=True, predictor=11, lz77=True)]
    for b in batches:
        made = []
        for key, vector in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
            if not vector:
                made.append(None)
                continue
            q = np.clip(np.floor((np.array(vector, np.float64) + 1) * 127.5), 0, 255).astype(np.uint32)
            p = np.uint32(0xFF000000) | q << np.uint32(16) | (q * np.uint32(3) % np.uint32(256)) << np.uint32(8) | (np.uint32(255) - q)
            made.append(encode(p.reshape(-1, 8) if len(p) % 8 == 0 else p.reshape(1, -1), **ways[(key or 0) % len(ways)]))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(made, pa.binary())], names=["vec_id", "image"])


def thumbnails(embeddings: DataFrame) -> DataFrame:
    """vec_id and a lossless WebP ``image`` of each vector: its values as pixels, eight to a row."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_drawn, "vec_id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of every vector's image, drawn and decoded. The tables hold no images, so those of ``embeddings`` are drawn first."""
    return decode_column(thumbnails(table(spark, sf_dir, "embeddings"))).select("vec_id", "width", "height", "pixels")


_Q = "CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS BIGINT)"
ORACLE_SQL = f"""
SELECT vec_id, CAST(8 AS INTEGER) AS width, CAST(len(embedding) // 8 AS INTEGER) AS height,
       list_transform(list_transform(embedding, lambda e: {_Q}), lambda q: 4278190080 + q * 65536 + (q * 3 % 256) * 256 + (255 - q)) AS pixels
FROM embeddings"""
