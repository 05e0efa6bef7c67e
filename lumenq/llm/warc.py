"""A deterministic, sharded WARC writer.

Pages are sorted by the reversed host and path of their address, cut into ranges
at keys that depend on the pages only (quantiles of a sample picked by content
hash), and written range by range as WARC 1.1 response records, each a gzip
member, in files that roll at a compressed size. Headers, ids and digests are
made anew from the content, and the date is a parameter, so the same pages give
the same bytes whatever the partitioning, the order of tasks or lost executors.
A file has a temporary name until it is whole; the manifest, written last and
renamed into place, names the files that count.

Edges: a null page is an empty payload; a null address has no target header and
sorts first; control characters in addresses are percent-encoded; equal rows are
written as often as they occur, with equal ids; an empty table has a manifest
without files. A record is never split, so one that is larger than the limit has
a file of its own. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm.shared import new_dir, table

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 1 << 30
#: Pages' bytes of a range, which is one task's; beyond MAX_RANGES of them ranges are larger instead, so that keys and files that the driver holds are bounded.
RANGE_BYTES, MAX_RANGES = 32 << 20, 20_000
#: Sampled keys for each range.
SAMPLE = 32
SCHEMA = "page_id long, url string, file string, record_start long, record_bytes int, payload_digest string, record_id string"


def sort_key(url: Column) -> Column:
    """``http://a.b.org/x`` as ``org,b,a)/x``; an address without a host as it is."""
    host, rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", "")
    return F.coalesce(F.when(host != "", F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> tuple[str, bytes]:
    """Record id and uncompressed record."""
    ident = str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(repr((kind, headers, date)).encode() + block).hexdigest()))
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return ident, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[str, str, bytes]:
    """Record id, payload digest and bytes of a page's record."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))]
    headers += [("WARC-Identified-Payload-Type", "text/html"), ("WARC-Payload-Digest", _digest(body)), ("Content-Type", "application/http; msgtype=response")]
    ident, raw = _record("response", [*headers, ("X-Page-ID", str(page_id))], block, date)
    return ident, _digest(body), raw


def info(name: str, date: str = DATE) -> bytes:
    return _record("warcinfo", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: lumenq\r\nformat: WARC File Format 1.1\r\n", date)[1]


def member(raw: bytes) -> bytes:
    """One gzip member, without a time or a name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(raw: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(start, size, headers, block) of each record of a file's bytes."""
    out, at = [], 0
    while at < len(raw):
        z = zlib.decompressobj(31)
        data = z.decompress(raw[at:])
        size = len(raw) - at - len(z.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        out.append((at, size, headers, rest[: int(headers["Content-Length"])]))
        at += size
    return out


class _Files:
    """The files of one range, one after the other."""

    def __init__(self, folder: str, part: int, roll: int, date: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.roll, self.date, self.n, self.out, self.size, self.holds = part, roll, date, 0, None, 0, 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        made = member(raw)
        if self.out is not None and self.holds and self.size + len(made) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.holds = self.fs.open_output_stream(self.temp), 0, 0
            head = member(info(self.name, self.date))
            self.out.write(head)
            self.size = len(head)
            self.n += 1
        at = self.size
        self.out.write(made)
        self.size += len(made)
        self.holds += 1
        return self.name, at, len(made)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.out = None


def _writer(folder: str, roll: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for b in batches:
            rows = []
            for part, page, url, html in zip(*(b.column(c).to_pylist() for c in ("part", "page_id", "url", "html")), strict=True):
                if files is None or files.part != part:
                    if files is not None:
                        files.close()
                    files = _Files(folder, part, roll, date)
                ident, digest, raw = response(page, url, html, date)
                rows.append((page, url, *files.add(raw), digest, ident))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        if files is not None:
            files.close()

    return run


def bounds(pages: DataFrame, parts: int, rows: int, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """Keys at which parts 1, 2, ... begin: quantiles of the rows whose content hash is 0 modulo a number, about ``sample`` for each part."""
    if parts < 2:
        return []
    every = max(1, rows // (parts * sample))
    got = pages.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(every)) == 0).select("key", F.coalesce("page_id", F.lit(-1)).alias("page")).orderBy("key", "page").collect()
    return sorted({(r.key, r.page) for k in range(1, parts) if got for r in [got[k * len(got) // parts]]})


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, date: str = DATE) -> DataFrame:
    """Write all pages under ``folder``; returns, for each page, where its record is. The manifest is ``manifest.json``."""
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", "html").withColumn("key", sort_key(F.col("url")))
    rows, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    cut = bounds(keyed.select("page_id", "url", "key"), max(1, min(MAX_RANGES, -(-size // range_bytes))), rows)
    keys = [(k.encode(), p) for k, p in cut]

    @F.pandas_udf("int")
    def part_of(key: pd.Series, page: pd.Series) -> pd.Series:
        from bisect import bisect_right

        return pd.Series(np.fromiter((bisect_right(keys, (k.encode(), -1 if pd.isna(p) else int(p))) for k, p in zip(key, page, strict=True)), np.int32, len(key)))

    placed = keyed.withColumn("part", part_of("key", "page_id"))
    apart = placed.repartitionById(len(cut) + 1, F.col("part")) if hasattr(DataFrame, "repartitionById") else placed.repartition(len(cut) + 1, "part")
    done = apart.sortWithinPartitions("part", "key", "page_id", "url", "html").mapInArrow(_writer(folder, roll, date), SCHEMA)
    done.write.mode("overwrite").parquet(f"{folder}/index")
    index = spark.read.schema(done.schema).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("record_start") + F.col("record_bytes")).alias("bytes")).orderBy("file").collect()
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.manifest.json.tmp") as out:
        out.write(json.dumps({"date": date, "files": [r.asDict() for r in files]}, sort_keys=True).encode())
    system.move(f"{path}/.manifest.json.tmp", f"{path}/manifest.json")
    return index


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's place in the WARC files."""
    folder = new_dir(spark, "warc")
    return write(table(spark, sf_dir, "pages"), folder if folder.startswith("file:") or "://" in folder else f"file://{folder}")
