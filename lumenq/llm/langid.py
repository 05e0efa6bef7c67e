"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte
n-grams of the lower-cased text tells the languages whose bit is 1 from the
others. A text's language is the codeword of least weighted loss against the
classifiers' margins: log(1 + exp(-z)), each bit weighted by how well it told
the training texts apart. A row is flagged as ambiguous, and not accepted, where
the second codeword is nearly as near (a low margin), where even the best one is
far (a high loss: another language or script), where much of the text, by windows
of ``WINDOW`` bytes, decodes to another language than the whole (mixed text), or where there
are no letters. The bounds are quantiles of the training rows held out, of
which each flags ``HELD_OUT_FLAGGED``; short texts, whose margins vary more, are held
against held-out texts cut as short.

The classifiers are trained here, on at most ``TRAIN_PER_LANGUAGE`` labelled
rows of each language (those with the least hash of their id), the only part
that a bound holds for. All texts are read whole.

Edges: a null or blank text, or one without letters, has language ``und`` and
isn't accepted; rows that repeat are judged alike; with no labelled rows, or one
language, all is ``und`` or that language; other columns are carried, save those
named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import textvec
from lumenq.llm.shared import table

TRAIN_PER_LANGUAGE = 1500
ORDERS = (2, 3, 4)
BUCKET_BITS = 15
#: Every HELD_OUT-th labelled text sets the bounds and trains nothing; each bound flags this share of them.
HELD_OUT, HELD_OUT_FLAGGED = 5, 0.003
#: Letters at which the next class of lengths begins.
LENGTHS = (15, 60, 240)
#: Bytes of a window, and the least share of letters in windows of another language that makes a text mixed.
WINDOW, LEAST_FOREIGN = 600, 0.1
MADE = ["pred_lang", "margin", "ambiguous", "accepted"]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 for each of n classes: all two-way splits up to 5 classes, else well separated random ones."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = 4 * int(np.ceil(np.log2(n))) + 7
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, length))
        if (np.abs(m.sum(0)) == n).any():
            continue
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best


def buckets(data: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the k-gram that begins at each byte; 2**BUCKET_BITS where the row ends before it does."""
    n = len(data)
    h = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(min(k, n)):
            h[: n - i] = h[: n - i] * np.uint32(0x01000193) ^ data[i:]
        h = (h * np.uint32(0x9E3779B1 + 2 * k)) >> np.uint32(32 - BUCKET_BITS)
    for i in range(1, k):
        at = offs[1:] - i
        h[at[at >= offs[:-1]]] = 1 << BUCKET_BITS
    return h


def _squeezed(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and bytes of the lower-cased texts with each byte that is no letter as a space; letters of each row."""
    offs, data = textvec.utf8(textvec.lower(arr))
    letter = _LETTER[data]
    at = np.concatenate([[0], np.cumsum(letter)])
    return offs, np.where(letter, data, np.uint8(32)), np.diff(at[offs])


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Model:
    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, scale: np.ndarray, bit_weights: np.ndarray, typical: float):
        self.langs, self.codes, self.weights, self.scale, self.bit_weights, self.typical = langs, codes, weights, scale, bit_weights, typical
        classes = len(LENGTHS) + 1
        self.least_margin, self.most_loss, self.most_foreign = np.zeros(classes), np.full(classes, np.inf), 1.0

    def margins(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's margin for each bit, and its letters; the same of each window, and the window's row."""
        offs, _ = textvec.utf8(arr)
        n, bits = len(arr), self.codes.shape[1]
        out, letters = np.zeros((n, bits), np.float32), np.zeros(n, np.int64)
        parts, part_letters, part_rows = [], [], []
        for i, j in textvec.pieces(offs, 1 << 18):
            o, d, letters[i:j] = _squeezed(arr.slice(i, j - i))
            if not len(d):
                continue
            total = np.zeros((len(d), self.weights.shape[2]), np.float32)
            for k, w in zip(ORDERS, self.weights, strict=True):
                total += w[buckets(d, o, k)]
            size = np.diff(o)
            full = np.flatnonzero(size > 0)
            count = np.maximum(1, np.round(size[full] / WINDOW).astype(np.int64))
            rows = np.repeat(full, count)
            first = np.cumsum(count) - count
            starts = o[rows] + (np.arange(len(rows)) - np.repeat(first, count)) * size[rows] // np.repeat(count, count)
            sums = np.add.reduceat(total, starts, axis=0, dtype=np.float32)[:, :bits]
            own = np.add.reduceat(d != 32, starts, dtype=np.int64)
            out[i + full] = np.add.reduceat(sums, first, axis=0) / np.maximum(1, letters[i + full])[:, None]
            parts.append(sums / np.maximum(1, own)[:, None])
            part_letters.append(own)
            part_rows.append(i + rows)
        if not parts:
            return out, letters, out[:0], letters[:0], letters[:0]
        return out, letters, np.concatenate(parts), np.concatenate(part_letters), np.concatenate(part_rows)

    def judge(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's best codeword, relative margin over the runner-up, loss, share of letters in windows of another language, and letters."""
        f, letters, parts, part_letters, part_rows = self.margins(arr)
        rows = np.arange(len(f))
        loss = self.losses(f)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        if len(self.langs) < 2:
            return best, np.ones(len(f)), np.zeros(len(f)), np.zeros(len(f)), letters
        margin = (loss[rows, order[:, 1]] - loss[rows, best]) / self.typical
        foreign = np.bincount(part_rows, part_letters * (np.argmin(self.losses(parts), axis=1) != best[part_rows]), minlength=len(f)) / np.maximum(1, letters)
        return best, margin, loss[rows, best], foreign, letters

    def decide(self, arr: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, relative margin over the runner-up, and whether it is ambiguous, for each row."""
        if not self.langs:
            n = len(arr)
            return ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
        best, margin, loss, foreign, letters = self.judge(arr)
        none = letters == 0
        margin = np.where(none, 0.0, margin)
        size = np.searchsorted(LENGTHS, letters, side="right")
        return [("und" if z else self.langs[b]) for z, b in zip(none, best, strict=True)], margin, none | (margin < self.least_margin[size]) | (loss > self.most_loss[size]) | (foreign > self.most_foreign)

    def losses(self, f: np.ndarray) -> np.ndarray:
        z = (f * self.scale)[:, None, :] * self.codes[None, :, :]
        return (np.logaddexp(0, -z) * self.bit_weights).sum(2)


def train(texts: list[str], labels: list[str]) -> Model:
    """The classifiers of all bits: log ratios of smoothed n-gram rates, scaled and weighted by how they do on the texts.

    Every HELD_OUT-th text of a language with that many sets the bounds of ambiguity instead; where
    there are few, the bounds are wider.
    """
    langs = sorted(set(labels))
    codes = codewords(len(langs))
    bits, size = codes.shape[1], (1 << BUCKET_BITS) + 1
    wide = -(-bits // 4) * 4
    weights = np.zeros((len(ORDERS), size, wide), np.float32)
    if not langs:
        return Model([], codes, weights, np.ones(0), np.ones(0), 1.0)
    seen, held, nth = [], [], dict.fromkeys(langs, 0)
    for i, x in enumerate(labels):
        nth[x] += 1
        (held if nth[x] % HELD_OUT == 0 else seen).append(i)
    which = np.array([langs.index(labels[i]) for i in seen])
    counts = np.zeros((len(ORDERS), len(langs), size))
    for c in range(len(langs)):
        arr = pa.array([texts[i] for i, w in zip(seen, which, strict=True) if w == c], pa.large_string())
        offs, data, _ = _squeezed(arr)
        for k, n in enumerate(ORDERS):
            counts[k, c] = np.bincount(buckets(data, offs, n), minlength=size)
    counts[:, :, -1] = 0
    rates = counts / np.maximum(1, counts.sum(2, keepdims=True))
    for b in range(bits):
        plus = codes[:, b] > 0
        if plus.all() or not plus.any():
            continue
        floor = 1.0 / size / 50
        w = np.log(rates[:, plus].mean(1) + floor) - np.log(rates[:, ~plus].mean(1) + floor)
        w[:, -1] = 0
        weights[:, :, b] = w
    model = Model(langs, codes, weights, np.ones(bits), np.ones(bits), 1.0)
    f, letters, *_ = model.margins(pa.array([texts[i] for i in seen], pa.large_string()))
    own = codes[which] * f
    own = own[letters > 0] if (letters > 0).any() else own
    model.scale = 4.0 / np.maximum(1e-6, np.median(np.abs(own), axis=0))
    model.bit_weights = np.maximum(1e-3, 2 * (own > 0).mean(0) - 1)
    model.bit_weights = model.bit_weights / model.bit_weights.sum()
    loss = model.losses(f)
    rest = np.delete(loss, np.argmin(loss, axis=1)[0], axis=1) if len(langs) == 1 else np.sort(loss, axis=1)[:, 1:]
    model.typical = float(rest.mean()) if rest.size else 1.0
    if len(langs) > 1:
        few = len(held) * HELD_OUT_FLAGGED < 1  # too few to show the quantile
        some, room = [texts[i] for i in (range(len(texts)) if few else held)], 2.0 if few else 1.0
        for c, least in enumerate((4, *LENGTHS)):
            # as many characters as have that many letters, or nearly so; the longest class takes whole texts
            _, margin, loss, foreign, letters = model.judge(pa.array([t if least == LENGTHS[-1] else t[: int(1.2 * least)] for t in some], pa.large_string()))
            enough = letters >= (least if least == LENGTHS[-1] else max(1, least // 2))
            if enough.any():
                model.least_margin[c] = np.quantile(margin[enough], HELD_OUT_FLAGGED) / room
                model.most_loss[c] = np.quantile(loss[enough], 1 - HELD_OUT_FLAGGED) * room
                model.most_foreign = max(LEAST_FOREIGN, float(np.quantile(foreign[enough], 1 - HELD_OUT_FLAGGED)) * room)
            elif c:
                model.least_margin[c], model.most_loss[c] = model.least_margin[c - 1], model.most_loss[c - 1]
    return model


def fit(docs: DataFrame, id_column: str = "doc_id", label: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """A model of at most ``per_language`` rows of each label, those of the least hashes of their id; rows with a null text or label aren't used.

    A count by label says below which hash about twice as many rows of it lie; only these are ranked.
    """
    spark = docs.sparkSession
    ids = docs.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(label, id_column)
    counts = ids.groupBy(label).count().collect()  # a row for each language
    schema = T.StructType([docs.schema[label], T.StructField("_cut", T.LongType())])
    cuts = spark.createDataFrame([(r[0], min((1 << 63) - 1, int(((2 * per_language + 100) / r["count"]) * (1 << 64)) - (1 << 63))) for r in counts], schema)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h", id_column))
    near = ids.withColumn("h", F.xxhash64(id_column)).join(F.broadcast(cuts), label).where("h <= _cut")
    picked = [r[0] for r in near.withColumn("r", rank).where(F.col("r") <= per_language).select(id_column).collect()]  # at most per_language rows of each label
    chosen = spark.createDataFrame([(x,) for x in dict.fromkeys(picked)], T.StructType([docs.schema[id_column]]))
    got = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(id_column, label, "text").join(F.broadcast(chosen), id_column)
    # hashed n-gram counts leave the executors as texts of the bounded sample only
    rows = sorted(got.select(label, "text").toArrow().to_pylist(), key=lambda r: (r[label], r["text"]))
    return train([r["text"] for r in rows], [r[label] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with pred_lang, margin, ambiguous and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on buckets and languages only
    columns = [c for c in docs.columns if c not in MADE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, margin, unsure = m.decide(b.column("text"))
            made = [pa.array(lang, pa.string()), pa.array(margin.astype(np.float64)), pa.array(unsure), pc.invert(pa.array(unsure))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *made], names=[*columns, *MADE])

    types = [T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(n, t) for n, t in zip(MADE, types, strict=True)])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", "lang"), fit(docs)).drop("text")
