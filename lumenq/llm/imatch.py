"""I-Match document fingerprints.

Terms whose inverse document frequency lies in a band are kept: a term is in the
lexicon if it is in at least ``MIN_DF`` documents, at least ``LOW`` and at most
``HIGH`` of every thousand. A document's distinct lexicon terms, sorted, are
hashed once over the whole lexicon and once over each of ``SUBSETS`` randomised
lexicons, which each leave out a third of the terms. These are the columns of the
query and its SQL. They find exact copies; near copies seldom agree in one, since
most differ in a term that every one of the lexicons has (README gives figures).

``near_hashes`` is for near copies: a band of commoner terms, and ``LEXICONS`` small
randomised lexicons that each keep ``KEEP`` of 16 terms, so that some miss all terms
in which two copies differ. Fewer than ``LEAST`` terms say too little and have no
hash; a document without any hash has one of all its distinct terms instead.

The lexicon has at most (mean distinct terms of a document) / LOW terms however
large the corpus, since each is in LOW of a thousand documents; it is broadcast
as 64-bit hashes behind a check of its size, and joined to the documents beyond.

Edges: null and empty texts, and texts without a lexicon term, have null
hashes and ``n_terms`` 0 (and count among the documents); rows that repeat count
each; other columns are ignored but for ``doc_id``. ``near_hashes`` gives null and
empty texts an empty list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm import textvec
from lumenq.llm.shared import table, written

LOW, HIGH, MIN_DF = 1, 50, 2
SUBSETS = 5
#: Terms up to which the lexicon is broadcast (8 bytes each).
BROADCAST_TERMS = 4_000_000
NEAR_LOW, NEAR_HIGH = 10, 50
LEXICONS, KEEP, LEAST = 32, 3, 5
SCHEMA = "doc_id long, n_terms int, sig_all string, " + ", ".join(f"sig_{k} string" for k in range(SUBSETS))
NEAR_SCHEMA = "doc_id long, hashes array<long>"


def keeps(term: bytes) -> list[bool]:
    """Whether each randomised lexicon has the term."""
    return [hashlib.md5(b"%d:%s" % (k, term)).hexdigest()[0] > "4" for k in range(SUBSETS)]


def fingerprint(terms: list[bytes], cache: dict[bytes, list[bool]]) -> list[str | None]:
    """The hashes of sorted distinct lexicon terms: of all, then of those in each subset."""
    picks = []
    for t in terms:
        k = cache.get(t)
        if k is None:
            if len(cache) > 500_000:
                cache.clear()
            k = cache[t] = keeps(t)
        picks.append(k)
    lists = [terms, *([t for t, p in zip(terms, picks, strict=True) if p[k]] for k in range(SUBSETS))]
    return [hashlib.md5(b" ".join(x)).hexdigest() if x else None for x in lists]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each term, by the term's hash, summed over up to 32 MB of text."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int32())])
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int32))], schema=schema)

    for b in batches:
        for h in textvec.row_grams(b.column("text"), 1):
            held.append(h)
            size += len(h)
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def lexicon(docs: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hashes of the terms in the band."""
    n = docs.select(F.lit(1)).count()
    df = docs.select("text").mapInArrow(_frequencies, "term long, df int").groupBy("term").agg(F.sum("df").alias("df"))
    return df.where((F.col("df") >= MIN_DF) & (F.col("df") * 1000 >= low * n) & (F.col("df") * 1000 <= high * n)).select("term")


def _signed(b: pa.RecordBatch, known, cache: dict) -> pa.RecordBatch:
    """Fingerprints of a batch; ``known(row range, hashes)`` tells which hashes are in the lexicon."""
    text = textvec.lower(b.column("text"))
    offs, data = textvec.utf8(text)
    out = []
    for i, j in textvec.pieces(offs):
        o, d = offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        starts, ends, counts = textvec.term_spans(o, d)
        hs = textvec.span_hashes(d, starts, ends)
        at = np.concatenate([[0], np.cumsum(counts)])
        hit = np.flatnonzero(known(i, j, hs, at))
        cut = np.searchsorted(hit, at)
        raw, s, e = d.tobytes(), starts[hit].tolist(), ends[hit].tolist()
        for k in range(j - i):
            terms = sorted({raw[s[x] : e[x]] for x in range(cut[k], cut[k + 1])})
            out.append((len(terms), *fingerprint(terms, cache)))
    cols = list(zip(*out, strict=True)) if out else [[]] * (2 + SUBSETS)
    return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _sums(hashes: np.ndarray, at: np.ndarray, sel: np.ndarray) -> np.ndarray:
    """For each row, the hash of the set of its selected terms."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(sel, textvec.mix64(hashes), np.uint64(0)), dtype=np.uint64)])
        return total[at[1:]] - total[at[:-1]]


def _near(b: pa.RecordBatch, known, cache: dict) -> pa.RecordBatch:
    """Hashes of a batch over the small lexicons; the lexicon's number is part of a hash, so equal hashes are of the same one."""
    offs, _ = textvec.utf8(b.column("text"))
    out, rows = [], list(textvec.row_grams(b.column("text"), 1))
    for i, j in textvec.pieces(offs):
        hs = np.concatenate(rows[i:j])
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows[i:j]])])
        hit = np.asarray(known(i, j, hs, at), dtype=bool)
        made, good = np.zeros((LEXICONS + 1, j - i), np.uint64), np.zeros((LEXICONS + 1, j - i), dtype=bool)
        for k in range(LEXICONS + 1):
            salt = textvec.mix64(np.array([k + 1], np.uint64))
            if k < LEXICONS:
                sel = hit & ((textvec.mix64(hs ^ salt) & np.uint64(15)) < KEEP)
                good[k] = np.diff(np.concatenate([[0], np.cumsum(sel)])[at]) >= LEAST
            else:
                sel = np.ones(len(hs), dtype=bool)
                good[k] = ~good[:k].any(axis=0) & (np.diff(at) > 0)
            made[k] = textvec.mix64(_sums(hs, at, sel) ^ salt)
        signed = made.view(np.int64)
        out += [signed[good[:, x], x].tolist() for x in range(j - i)]
    return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "hashes"])


def fingerprints(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, n_terms, sig_all and the subsets' hashes."""
    return _against(docs, lexicon(docs), _signed, SCHEMA, broadcast_terms)


def near_hashes(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id and hashes; documents that share a hash are taken for near copies."""
    return _against(docs, lexicon(docs, NEAR_LOW, NEAR_HIGH), _near, NEAR_SCHEMA, broadcast_terms)


def _against(docs: DataFrame, lex: DataFrame, sign, schema: str, broadcast_terms: int) -> DataFrame:
    """``sign`` over the batches of documents, with the lexicon broadcast or joined."""
    spark = docs.sparkSession
    lex = written(lex, "lexicon")
    if lex.count() > broadcast_terms:
        return _by_join(docs, lex, sign, schema)
    terms = spark.sparkContext.broadcast(np.sort(np.array(lex.toArrow()["term"].to_numpy(), dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, cache = terms.value, {}
        # a table of marks by the hash's low bits sorts out nearly all terms before the search
        mark = np.zeros(1 << 22, dtype=bool)
        mark[sought & ((1 << 22) - 1)] = True

        def known(i, j, hs, at):
            h = hs.view(np.int64)
            got = mark[h & ((1 << 22) - 1)]
            some = np.flatnonzero(got)
            if len(sought):
                where = np.minimum(np.searchsorted(sought, h[some]), len(sought) - 1)
                got[some] = sought[where] == h[some]
            return got

        for b in batches:
            yield sign(b, known, cache)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(textvec.row_grams(b.column("text"), 1))
        n = np.array([len(x) for x in rows], dtype=np.int64)
        terms = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        keys = b.column("row_key").take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([keys, pa.array(terms.view(np.int64))], names=["row_key", "term"])


def _by_join(docs: DataFrame, lex: DataFrame, sign, schema: str) -> DataFrame:
    """For a lexicon too large to broadcast: each document gets its own lexicon terms by a join."""
    keyed = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("row_key"))
    own = keyed.select("row_key", "text").mapInArrow(_hashes, "row_key binary, term long").dropDuplicates().join(lex, "term").groupBy("row_key").agg(F.collect_list("term").alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            sets = [np.array(x or [], dtype=np.int64) for x in b.column("terms").to_pylist()]

            def known(i, j, hs, at, sets=sets):
                h = hs.view(np.int64)
                parts = [np.isin(h[at[k] : at[k + 1]], sets[i + k]) for k in range(j - i)]
                return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)

            yield sign(b, known, cache)

    return keyed.join(own, "row_key", "left").select("doc_id", "text", "terms").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    term = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    subset = ", ".join(f"md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('{k}:' || term), 1, 1) > '4')) AS sig_{k}" for k in range(SUBSETS))
    names = ", ".join(f"s.sig_{k}" for k in range(SUBSETS))
    return f"""
WITH terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM documents),
n AS (SELECT count(*) AS n FROM documents),
lexicon AS (SELECT term FROM terms, n GROUP BY term, n.n HAVING count(*) >= {MIN_DF} AND count(*) * 1000 >= {LOW} * n.n AND count(*) * 1000 <= {HIGH} * n.n),
s AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS sig_all, {subset}
      FROM terms JOIN lexicon USING (term) GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_terms, 0) AS n_terms, s.sig_all, {names} FROM documents d LEFT JOIN s USING (doc_id)"""


ORACLE_SQL = _oracle()
