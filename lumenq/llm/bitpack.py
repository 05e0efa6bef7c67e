"""Token ids as fixed-width bits.

Every id takes the fewest bits that hold the vocabulary (16 for 50,257 ids). A
row's ids are packed, lowest bit first, into blocks of ``BLOCK`` ids, each
beginning at a whole byte; ``block_offsets`` has each block's first byte and at
its end the total, so any id or range is found without reading what precedes it,
and a block unpacks in one numpy pass.

Edges: null ids (or a null text) give a null payload, no ids an empty payload and
the offsets [0]; an id below 0 or too large for the width raises ValueError;
rows that repeat are packed alike; other columns are carried, save those named
like an output column.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import bpe, textvec
from lumenq.llm.shared import table

BLOCK = 4096
MADE = ["bits", "n_tokens", "block_offsets", "packed"]
_TYPES = [T.StructField("bits", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("block_offsets", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType())]


def width(n_vocab: int) -> int:
    """Bits that hold the ids 0 .. n_vocab - 1."""
    if n_vocab < 1:
        raise ValueError("a vocabulary has at least one id")
    return max(1, (n_vocab - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.int64)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return planes.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Payload and block offsets of one row's ids."""
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id needs more than {bits} bits, or is below 0")
    parts = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(int).tolist()


def read(packed: bytes, offsets: list[int], bits: int, n: int, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids start .. stop - 1; only the blocks that hold them are looked at."""
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.int64)
    out = [unpack_block(packed[offsets[k] : offsets[k + 1]], bits, min(block, n - k * block)) for k in range(start // block, (stop - 1) // block + 1)]
    first = start // block * block
    return np.concatenate(out)[start - first : stop - first]


def _row(ids: np.ndarray, bits: int, block: int) -> tuple[int, int, list[int], bytes]:
    raw, offsets = pack(ids, bits, block)
    return bits, len(ids), offsets, raw


def _batch(b: pa.RecordBatch, columns: list[str], rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    made = [pa.array([None if r is None else r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *made], names=[*columns, *MADE])


def pack_ids(coded: DataFrame, n_vocab: int, block: int = BLOCK) -> DataFrame:
    """``coded`` with its ``token_ids`` packed: bits, n_tokens, block_offsets, packed."""
    bits = width(n_vocab)
    columns = [c for c in coded.columns if c not in (*MADE, "token_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b, columns, [None if x is None else _row(np.array(x, np.int64), bits, block) for x in b.column("token_ids").to_pylist()])

    return coded.select(*[F.col(f"`{c}`") for c in columns], "token_ids").mapInArrow(run, T.StructType([coded.schema[c] for c in columns] + _TYPES))


def pack_texts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, n_vocab: int | None = None, block: int = BLOCK) -> DataFrame:
    """Documents' texts encoded and packed in one pass, without a shuffle."""
    columns = [c for c in docs.columns if c not in (*MADE, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.Coder.of(vocabulary)
        bits = width(n_vocab or coder.n_vocab)
        for b in batches:
            offs, _ = textvec.utf8(b.column("text"))
            for i, j in textvec.pieces(offs, bpe.STEP_BYTES):
                part = b.slice(i, j - i)
                there = part.column("text").is_valid().to_pylist()
                o, ids = coder.batch(part.column("text"))
                yield _batch(part, columns, [_row(ids[o[k] : o[k + 1]], bits, block) if ok else None for k, ok in enumerate(there)])

    return docs.select(*[F.col(f"`{c}`") for c in columns], "text").mapInArrow(run, T.StructType([docs.schema[c] for c in columns] + _TYPES))


def _unpacked(block: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = zip(*[b.column(c).to_pylist() for c in MADE], strict=True)
            ids = [None if raw is None else read(raw, offs, bits, n, block=block).tolist() for bits, n, offs, raw in got]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(ids, pa.list_(pa.int32()))], names=[*columns, "token_ids"])

    return run


def unpack(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The inverse of ``pack_ids``: ``token_ids`` in place of the packed columns."""
    columns = [c for c in packed.columns if c not in (*MADE, "token_ids")]
    schema = T.StructType([packed.schema[c] for c in columns] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return packed.mapInArrow(_unpacked(block, columns), schema)


def write_bins(packed: DataFrame, folder: str) -> DataFrame:
    """Payloads as ``.bin`` files in a mounted folder, one for each partition, each under a temporary name until whole.

    Returns, for each row, its file and the byte at which its payload begins; rows without payload have a null file.
    """
    columns = [c for c in packed.columns if c not in (*MADE, "file", "byte_start")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}.bin"
        temp, at, kept = f"{folder}/.{name}.{uuid.uuid4().hex}", 0, []
        with open(temp, "wb") as f:
            for b in batches:
                files, starts = [], []
                for raw in b.column("packed").to_pylist():
                    files.append(None if raw is None else name)
                    starts.append(None if raw is None else at)
                    at += f.write(raw or b"")
                own = [b.column(c) for c in (*columns, "bits", "n_tokens", "block_offsets")]
                kept.append(pa.RecordBatch.from_arrays([*own, pa.array(files, pa.string()), pa.array(starts, pa.int64())], names=[*columns, "bits", "n_tokens", "block_offsets", "file", "byte_start"]))
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, f"{folder}/{name}")
        yield from kept

    schema = T.StructType([packed.schema[c] for c in columns] + _TYPES[:3] + [T.StructField("file", T.StringType()), T.StructField("byte_start", T.LongType())])
    return packed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed token ids of every document."""
    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
