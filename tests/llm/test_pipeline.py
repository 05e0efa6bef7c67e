"""The pipeline against a brute-force version, and its stages over odd tables."""

import random

import pyarrow as pa

import corpus_pipeline as P
from lumenq.llm import bpe, jaccard, langid, packing, pii
from tests.llm.test_spark import DOCS, brute_pairs

VOCAB = {"en": "the of and thing other with from was".split(), "de": "der und nicht schön heit auf mit dem".split()}


def corpus():
    rows = []
    for k in range(40):
        r, lang = random.Random(k), ("en", "de")[k % 2]
        rows.append((k, " ".join(r.choice(VOCAB[lang]) + r.choice(["", "s", "er", "en"]) for _ in range(80)), lang, "s", 0))
    near = rows[4][1].split()
    near[7] = "changed"
    rows += [(40, rows[3][1], "de", "s", 0), (41, " ".join(near), "en", "s", 0), (42, "!!! 123", "en", "s", 0), (43, "the thing with of jo.do@mail.example.org and 10.2.3.4 from", "en", "s", 0), (44, None, "en", "s", 0), (45, "", "de", "s", 0), rows[5]]
    return [(*x[:4], len(x[1] or "")) for x in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    bins = P.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[1] and r[0] != 42]
    lang, _, unsure = langid.fit(spark.createDataFrame(rows, DOCS)).decide(pa.array([r[1] for r in kept]))
    assert not unsure.any() and lang == [r[2] for r in kept]
    pairs, gone = brute_pairs(kept), set()
    root = {r[0]: r[0] for r in kept}
    for _ in kept:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    gone = {k for k, v in root.items() if k != v}
    assert {40, 41} <= gone
    want = {}
    for k, text in {r[0]: r[1] for r in kept if r[0] not in gone}.items():
        want[k] = len(bpe.Coder.of(bpe.VOCABULARY).one(pii.rewrite(text, pii.session_key())[0]))
    held = {}
    for b in bins:
        for d, n in zip(b.doc_ids, b.lengths, strict=True):
            held[d] = held.get(d, 0) + n
    assert held == want and all(sum(b.lengths) == b.used <= b.capacity for b in bins)
    order = sorted(want)
    assert sorted(b.used for b in bins) == sorted(sum(want[order[i]] for i in x) for x in packing.pack_lengths([want[k] for k in order], packing.CAPACITY))


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    empty = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert [n for n, _ in P.STAGES] == ["langid", "near_duplicates", "pii", "packing"]


def test_stages_leave_clashing_columns_as_they_are(spark, tmp_path):
    names = [*langid.MADE, "n_pii", "th", "keeper", "root", "g", "n", "bin_id"]
    spark.createDataFrame(corpus(), DOCS).selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_near_duplicates_of_odd_rows(spark):
    t, u = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    rows = [(5, t, "en", "s", 1), (5, t, "en", "s", 1), (6, t + " more", "en", "s", 1), (None, t, "en", "s", 1), (7, None, "en", "s", 1), (8, None, "en", "s", 1)]
    rows += [(9, t, "en", "s", 1), (9, u, "fr", "s", 2), (9, u, "de", "s", 2), (9, u, "de", "s", 1)]
    clash = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as th", "doc_id as keeper")
    for docs in (spark.createDataFrame(rows, DOCS), clash):
        kept = P.near_duplicates(spark, docs, "").collect()
        assert sorted(((r.doc_id or 0), r.text == u, r.lang, r.n_chars) for r in kept) == [(0, False, "en", 1), (5, False, "en", 1), (7, False, "en", 1), (8, False, "en", 1), (9, True, "de", 1)]
        assert kept[0].asDict().keys() == set(docs.columns)
    assert jaccard.groups(spark.createDataFrame([], DOCS)).count() == 0
