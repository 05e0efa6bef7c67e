"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, so that passages
which documents share fall into equal chunks wherever they stand. A chunk that
occurs more than once in the corpus is encoded once; documents take its ids by
a join on the chunk's hash. The ids at a chunk's two ends depend on its
neighbours, so each join is repaired: from the last safe point before it to the
first safe point behind it the text is encoded again, and the ids that go must
equal the encoding of the text they stand for; while they don't, the next safe
point is taken, up to the whole of both pieces.

A safe point is a space or line break behind a byte that is surely no white
space. The pre-tokenizer's pattern always starts a new match there and looks no
further ahead or back, so encodings on either side don't depend on each other.

Edges: a null text gives null ids, an empty one no ids; rows that repeat (equal
``doc_id`` included) have the ids of their text; other columns are carried, whatever
their names (but ``__near``, ``__key`` and ``__spans``, which are used inside), except
those named like an output column, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import textvec
from lumenq.llm.shared import among, table, without, written

VOCABULARY = os.environ.get("LUMENQ_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the rolling window, and the mask: a chunk has 1024 bytes on average.
WINDOW, MASK = 32, 1023
_coders: dict[str, Coder] = {}  # noqa: F821


class Coder:
    """A byte-level BPE vocabulary with a batch encoder that encodes each distinct segment once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = max(ranks.values()) + 1
        #: What ids have between tasks: two bytes where the vocabulary fits.
        self.narrow = "<u2" if self.n_vocab <= 1 << 16 else "<u4"
        self.pieces: list[bytes] = [b""] * self.n_vocab
        for k, v in ranks.items():
            self.pieces[v] = k
        self.lengths = np.array([len(x) for x in self.pieces], dtype=np.int64)
        self.bytes_at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.all_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    @staticmethod
    def of(path: str) -> Coder:
        if path not in _coders:
            _coders[path] = Coder(path)
        return _coders[path]

    def one(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        return _ragged(self.all_bytes, self.bytes_at[ids], self.lengths[ids]).tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all rows; nulls are as empty texts. Equals ``one`` on every row."""
        offs, data = textvec.utf8(texts)
        starts, counts = segments(offs, data)
        if not len(starts):
            return np.zeros(len(offs), np.int64), np.zeros(0, np.int32)
        bounds = np.append(starts, len(data)).astype(np.int64)
        seg = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(seg)
        o, ids = self._distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = (o[1:] - o[:-1])[which]
        out = _ragged(ids, o[:-1][which], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[np.concatenate([[0], np.cumsum(counts)])], out

    def _distinct(self, segs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of segments, encoded as one text: they are split at safe points, where encodings part."""
        n = len(segs)
        o = np.frombuffer(segs.buffers()[1], np.int64)[: n + 1]
        raw = np.frombuffer(segs.buffers()[2], np.uint8)[: o[-1]].tobytes()
        first = np.frombuffer(raw, np.uint8)[o[:-1]]
        tail = _surely_black(np.frombuffer(raw, np.uint8), o[1:] - 1)
        joined = ((first == 32) | (first == 10)) & np.concatenate([[True], tail[:-1]])
        sizes, parts, i = np.zeros(n, np.int64), [], 0
        breaks = np.append(np.flatnonzero(~joined), n)
        for j in breaks.tolist():  # runs of segments that may stand behind each other
            if j > i:
                ids = np.array(self.one(raw[o[i] : o[j]].decode()), dtype=np.int32)
                at = np.concatenate([[0], np.cumsum(self.lengths[ids])]) + o[i]
                k = np.searchsorted(at, o[i : j + 1])
                sizes[i:j] = np.diff(k)
                parts.append(ids)
            i = j
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _surely_black(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is surely no white space."""
    b = data[at]
    lead = data[np.maximum(at - 1, 0)]
    return _BLACK[b] | (_HIGH[b] & _LEAD[lead] & (at > 0))


_BLACK, _HIGH, _LEAD, _BREAK = (np.zeros(256, dtype=bool) for _ in range(4))
_BLACK[33:127], _HIGH[128:], _LEAD[0xC3:0xE0] = True, True, True
_BREAK[[10, 32]] = True


def _safe(data: np.ndarray) -> np.ndarray:
    """Marks of the safe points among bytes."""
    n = len(data)
    mark = np.zeros(n, dtype=bool)
    if n > 1:
        high = _HIGH[data[:-1]]
        high[1:] &= _LEAD[data[:-2]]
        high[0] = False
        np.logical_and(_BREAK[data[1:]], _BLACK[data[:-1]] | high, out=mark[1:])
    return mark


def safe_points(data: np.ndarray) -> np.ndarray:
    """The safe points among bytes: where an encoding may be cut without changing it."""
    return np.flatnonzero(_safe(data))


def segments(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts between safe points and row bounds, and how many each row has."""
    mark = _safe(data)
    mark[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(mark)
    return starts, np.diff(np.searchsorted(starts, offs))


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    total = int(sizes.sum())
    if not total:
        return values[:0]
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    where += np.arange(total)
    return values[where]


def cuts(data: np.ndarray) -> np.ndarray:
    """Content-defined cut points inside one text: where the rolling hash of the last WINDOW bytes
    has its low bits zero, moved on to the next character's start."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # 32-bit Rabin-Karp over a window, from prefix sums: h(i) = sum of byte(k) * r^(i-k)
        p = np.cumsum(textvec._BYTE[data] * textvec._power(textvec._RINV, n), dtype=np.uint64)
        h = p.copy()
        h[WINDOW:] -= p[:-WINDOW]
        h = (h * textvec._power(textvec._R, n)) >> np.uint64(40)
    at = np.flatnonzero((h[WINDOW - 1 : -1] & np.uint64(MASK)) == 0) + WINDOW
    while len(at) and ((data[at] & 0xC0) == 0x80).any():
        at = at + ((data[at] & 0xC0) == 0x80)
        at = at[at < n]
    return np.unique(at)


def chunk_hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def chunks_of(data: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of one text's chunks."""
    if not len(data):
        return []
    raw = data.tobytes()
    b = [0, *cuts(data).tolist(), len(raw)]
    return [(s, e, chunk_hash(raw[s:e])) for s, e in zip(b, b[1:])]


def join_pieces(coder: Coder, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Text and ids of two pieces as one, repaired around the join."""
    (a, ia), (b, ib) = left, right
    if not a or not b:
        return (a + b, np.concatenate([ia, ib]))
    # points near the join, nearest first; the ends of the pieces are the last resort
    reach = 256
    while True:
        pa_ = safe_points(np.frombuffer(a[-reach:], np.uint8))[::-1] + max(0, len(a) - reach)
        pb_ = safe_points(np.frombuffer(b[:reach], np.uint8))
        if (len(pa_) and len(pb_)) or reach >= max(len(a), len(b)):
            break
        reach *= 4
    lefts, rights = [*pa_.tolist(), 0], [*pb_.tolist(), len(b)]
    for k in range(max(len(lefts), len(rights))):
        s, e = lefts[min(k, len(lefts) - 1)], rights[min(k, len(rights) - 1)]
        gone_a, gone_b = _encode_bytes(coder, a[s:]), _encode_bytes(coder, b[:e])
        fits = np.array_equal(ia[len(ia) - len(gone_a) :], gone_a) and np.array_equal(ib[: len(gone_b)], gone_b)
        if fits or (s == 0 and e == len(b)):
            keep_a = ia[: len(ia) - len(gone_a)] if s else ia[:0]
            keep_b = ib[len(gone_b) :] if e < len(b) else ib[:0]
            return a + b, np.concatenate([keep_a, _encode_bytes(coder, a[s:] + b[:e]), keep_b])
    raise AssertionError("unreachable")


def _encode_bytes(coder: Coder, raw: bytes) -> np.ndarray:
    return np.array(coder.one(raw.decode()), dtype=np.int32) if raw else np.zeros(0, np.int32)


def assemble(coder: Coder, raw: bytes, known: list[tuple[int, int, np.ndarray]], own: list[np.ndarray] | None = None) -> np.ndarray:
    """Ids of a text from its known chunks (start, end, ids) and its own parts between them, joins repaired.

    ``own`` has the ids of the parts between, in order, if they are encoded already.
    """
    parts: list[tuple[int, int, np.ndarray]] = []
    at, k = 0, 0
    for s, e, ids in [*known, (len(raw), len(raw), None)]:
        if s > at:
            parts.append((at, s, own[k] if own is not None else _encode_bytes(coder, raw[at:s])))
            k += 1
        if ids is not None:
            parts.append((s, e, ids))
        at = e
    # joins are repaired pairwise against a bounded tail, so long texts take linear time
    done: list[np.ndarray] = []
    text, ids = b"", np.zeros(0, np.int32)
    for s, e, new in parts:
        text, ids = join_pieces(coder, (text, ids), (raw[s:e], new))
        if len(text) > 4096:
            points = safe_points(np.frombuffer(text, np.uint8))
            points = points[points < len(text) - 1024]
            if len(points):
                cut = int(points[-1])
                tail = _encode_bytes(coder, text[cut:]) if len(text) - cut < 2048 else None
                if tail is not None and np.array_equal(ids[len(ids) - len(tail) :], tail):
                    done.append(ids[: len(ids) - len(tail)])
                    text, ids = text[cut:], tail
    return np.concatenate([*done, ids]).astype(np.int32)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("near", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("h", pa.binary())])
    for b in batches:
        offs, data = textvec.utf8(b.column("text"))
        at, ss, ns, hs = [], [], [], []
        for i in range(b.num_rows):
            for s, e, h in chunks_of(data[offs[i] : offs[i + 1]]):
                at.append(i)
                ss.append(s)
                ns.append(e - s)
                hs.append(h)
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), b.column("near").take(pa.array(at, pa.int64())), pa.array(ss, pa.int32()), pa.array(ns, pa.int32()), pa.array(hs, pa.binary())], schema=schema)


def _encode_shared(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            hs, texts = [], []
            offs, data = textvec.utf8(b.column("text"))
            for i, spans in enumerate(b.column("spans").to_pylist()):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                for x in spans:
                    hs.append(x["h"])
                    texts.append(raw[x["start"] : x["start"] + x["size"]].decode())
            o, ids = coder.batch(pa.array(texts, pa.large_string()))
            small = ids.astype(coder.narrow)
            yield pa.RecordBatch.from_pydict({"h": pa.array(hs, pa.binary()), "ids": pa.array([small[o[k] : o[k + 1]].tobytes() for k in range(len(hs))], pa.binary())})

    return run


#: The column of a row's known chunks between the join and the encoder.
SPANS = "__spans"
#: Bytes of text that a worker encodes at once.
STEP_BYTES = 4 << 20


def _assembled(coder: Coder, b: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    offs, data = textvec.utf8(b.column("text"))
    valid = b.column("text").is_valid().to_numpy(zero_copy_only=False)
    spans = b.column(SPANS).to_pylist() if SPANS in b.schema.names else [None] * b.num_rows
    raws, own_text, counts, known_of = [], [], [], []
    if any(spans):
        # the parts that no shared chunk covers, of all rows, are encoded in one go
        for i, got in enumerate(spans):
            raw = data[offs[i] : offs[i + 1]].tobytes()
            known = sorted(((x["start"], x["start"] + x["size"], np.frombuffer(x["ids"], coder.narrow).astype(np.int32)) for x in got or []), key=lambda x: x[0])
            at, n = 0, 0
            for s, e in [*((s, e) for s, e, _ in known), (len(raw), len(raw))]:
                if s > at:
                    own_text.append(raw[at:s].decode())
                    n += 1
                at = e
            raws.append(raw)
            known_of.append(known)
            counts.append(n)
        o, ids = coder.batch(pa.array(own_text, pa.large_string()))
        out, k = [], 0
        for raw, known, n in zip(raws, known_of, counts, strict=True):
            own = [ids[o[x] : o[x + 1]] for x in range(k, k + n)]
            k += n
            out.append(assemble(coder, raw, known, own) if known else own[0] if own else ids[:0])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
    else:
        ends, flat = coder.batch(b.column("text"))
    back = coder.decode(flat)
    bytes_at = np.concatenate([[0], np.cumsum(coder.lengths[flat])])[ends]
    whole = data.tobytes()
    same = [back[bytes_at[i] : bytes_at[i + 1]] == whole[offs[i] : offs[i + 1]] if valid[i] else None for i in range(b.num_rows)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(~valid))
    made = [lists, pa.array(np.where(valid, np.diff(ends), 0), pa.int32()), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *made], names=[*columns, "token_ids", "n_tokens", "decodes_back"])


def _assemble_rows(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            offs, _ = textvec.utf8(b.column("text"))
            for i, j in textvec.pieces(offs, STEP_BYTES):
                yield _assembled(coder, b.slice(i, j - i), columns)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with ``text``) without its text, with token_ids, n_tokens and decodes_back, each row as its whole text encodes.

    ``decodes_back``: the ids, decoded, are the text's bytes; null where the text is null.
    """
    made = {"token_ids", "n_tokens", "decodes_back", "text"}
    columns = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # Texts are told apart by 128 bits; 64 of another hash sort out which rows have to be moved, and may take one too many.
    base = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text"), F.xxhash64("text").alias("__near"))
    key = F.unhex(F.md5("text"))
    texts = docs.select("text", key.alias("key"), F.xxhash64("text").alias("near")).where(F.length("text") > 0)
    found = written(texts.select("key", "near", "text").mapInArrow(_chunk_rows, "key binary, near long, start int, size int, h binary"), "chunks")
    shared = written(
        found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("key", "near", "start", "size")).alias("first")).where("n > 1").select("h", "first.key", "first.near", "first.start", "first.size"),
        "shared",
    )
    owners = shared.groupBy("key", "near").agg(F.collect_list(F.struct("start", "size", "h")).alias("spans"))
    # only texts that own a shared chunk are moved here, and only those that have one below
    own = among(texts, owners, "near").join(owners.drop("near"), "key").dropDuplicates(["key"])
    coded = written(own.select("text", "spans").mapInArrow(_encode_shared(vocabulary), "h binary, ids binary"), "coded").dropDuplicates(["h"])
    uses = written(found.dropDuplicates(["key", "start"]).join(shared.select("h"), "h", "left_semi"), "uses")
    spans = uses.join(coded, "h").groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "size", "ids")).alias(SPANS))
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("decodes_back", T.BooleanType())])
    moved = uses.select(F.col("near").alias("__near"))
    alone = without(base, moved, "__near").mapInArrow(_assemble_rows(vocabulary, columns), schema)
    joined = among(base, moved, "__near").withColumn("__key", key).join(spans, "__key", "left").mapInArrow(_assemble_rows(vocabulary, columns), schema)
    return alone.unionByName(joined)


def _encode_plain(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            offs, _ = textvec.utf8(b.column("text"))
            for i, j in textvec.pieces(offs, STEP_BYTES):
                part = b.slice(i, j - i)
                text = part.column("text")
                o, ids = coder.batch(text)
                gone = text.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(ids), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists], names=[*columns, "token_ids"])

    return run


def encode_plain(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``encode``, without chunks: only ``token_ids``, in one pass with no shuffle."""
    columns = [c for c in docs.columns if c not in ("text", "token_ids")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{c}`") for c in columns], "text").mapInArrow(_encode_plain(vocabulary, columns), schema)


def _decode_rows(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            out = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(out, pa.string())], names=[*columns, "text"])

    return run


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The frame with ``text`` in place of ``token_ids``; bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    columns = [c for c in coded.columns if c not in ("text", "token_ids")]
    schema = T.StructType([coded.schema[c] for c in columns] + [T.StructField("text", T.StringType())])
    return coded.select(*[F.col(f"`{c}`") for c in columns], "token_ids").mapInArrow(_decode_rows(vocabulary, columns), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
