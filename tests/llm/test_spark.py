"""The operators over small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import gzip
import hashlib
import itertools
import json
import random
import re
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.llm import bitpack, bpe, imatch, jaccard, langid, packing, pii, registry, sharding, textvec, warc, webp
from lumenq.llm.shared import among, without

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgé", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [words(k, 60 + 30 * k) for k in range(8)]
    near = base[3].split()
    near[5], near[50] = "changed", "words"
    texts = [*base, base[2], base[2], " ".join(near), base[4] + " tail", words(99, 20000), "", None, "one", "one", "mail jo.do@mail.example.org or 152.1.2.3"]
    out = [(k, t, ("en", "de")[k % 2], f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[1], (None, base[5], "en", None, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bitpack(docs, none, rows):
    coder = bpe.Coder.of(bpe.VOCABULARY)
    packed = bitpack.pack_texts(docs.withColumn("bits", F.lit("clash")), block=256)
    got = bitpack.unpack(packed, 256).select("doc_id", "token_ids").collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None:
            assert r.token_ids == (None if text[r.doc_id] is None else coder.one(text[r.doc_id]))
    assert bitpack.pack_texts(none).count() == 0
    again = bitpack.pack_ids(bpe.encode_plain(docs), coder.n_vocab, 256).orderBy("doc_id").select("packed").collect()
    assert again == packed.orderBy("doc_id").select("packed").collect()


def test_bin_files(docs, tmp_path):
    packed = bitpack.pack_texts(docs.where("doc_id < 9")).cache()
    want = {r.doc_id: bytes(r.packed) for r in packed.collect()}
    for r in bitpack.write_bins(packed, str(tmp_path / "bins")).collect():
        raw = (tmp_path / "bins" / r.file).read_bytes()[r.byte_start :][: len(want[r.doc_id])]
        assert raw == want[r.doc_id]


def test_bpe(spark, docs, none, rows):
    coder = bpe.Coder.of(bpe.VOCABULARY)
    clash = {c: F.lit(c) for c in ("row_key", "spans", "key", "near", "h", "start", "first", "n")}
    got = bpe.encode(docs.withColumns({"token_ids": F.lit(1), **clash})).collect()
    assert len(got) == len(rows) and all(r[c] == c for r in got for c in clash)
    text = {(r[0], r[4]): r[1] for r in rows}
    for r in got:
        t = text[r.doc_id, r.n_chars]
        assert r.token_ids == (None if t is None else coder.one(t)) and r.decodes_back == (None if t is None else True)
    assert bpe.encode(none).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode_plain(docs)).collect()}
    assert all(back[r[0]] == r[1] for r in rows)


def brute_pairs(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    sets = {}
    for r in rows:
        w = re.findall(textvec.TERM_PATTERN, (r[1] or "").lower())
        if w and r[0] is not None:
            sets[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if len(x & y) >= t * len(x | y)}


def pairs_of(out):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in out}
    assert len(got) == len(out) and all(a < b for a, b in got)
    return got


def same_pairs(got, want):
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_jaccard_equals_brute_force(docs, none, rows):
    want = brute_pairs(rows)
    assert {(2, 8), (2, 9), (8, 9), (3, 10), (15, 16)} <= set(want)
    clash = docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("th", "sid", "sno", "rep", "jaccard", "doc_a", "copies")])
    for df in (docs, clash):
        same_pairs(pairs_of(jaccard.join(df).collect()), want)
    same_pairs(pairs_of(jaccard.join(docs, broadcast_copies=0).collect()), want)
    assert jaccard.join(none).count() == 0


@pytest.mark.parametrize(("n", "threshold"), [(1, 0.4), (2, 0.3), (3, 0.8), (1, 0.9)])
def test_jaccard_at_other_settings(spark, n, threshold):
    r = random.Random(n)
    rows = [(k, " ".join(r.choices("alpha beta gamma delta eps zeta eta theta".split(), k=r.randint(0, 7)))) for k in range(120)]
    rows += [(200, "alpha"), (201, "alpha beta"), (202, None), *rows[:3]]
    for k in range(40):
        w = [f"w{k % 5}x{i}" for i in range(30 + 60 * (k % 4))]
        for i in r.sample(range(len(w)), (k // 5) * len(w) // 60):
            w[i] = f"y{k}x{i}"
        rows.append((300 + k, " ".join(w)))
    want = brute_pairs(rows, n, threshold)
    same_pairs(pairs_of(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), n, threshold).collect()), want)
    assert len(want) > 10 and ((n, threshold) != (1, 0.4) or (200, 201) in want)


def test_jaccard_of_large_sets(spark):
    """Pairs just above the threshold whose sets are sampled: at least 0.95 are found, none is made up."""
    r, rows = random.Random(11), []
    for k in range(150):
        size = r.choice((200, 500, 900))
        w = [f"a{k}x{i}" for i in range(size)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: int(size * r.uniform(0.655, 0.68)) + 1]))]
    got, want = pairs_of(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), brute_pairs(rows)
    assert set(got) <= set(want) and len(want) == 150 and len(got) >= 0.95 * len(want)


def test_jaccard_of_a_doc_id_with_several_texts(spark):
    a, b, near = words(1, 60), words(2, 60), words(1, 60) + " tail"
    rows = [(1, a), (1, b), (2, b), (3, near), (3, a), (4, b), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs_of(jaccard.join(df).collect())
    assert got == {p: 1.0 for p in ((1, 2), (1, 4), (2, 4), (1, 3))}
    found = {(r.doc_id, r.th): (r.keeper, r.keeper_th) for r in jaccard.groups(df).collect()}
    th = {r.text: r.th for r in df.select("text", F.xxhash64("text").alias("th")).collect()}
    assert found == {(1, th[b]): (1, th[b]), (2, th[b]): (1, th[b]), (4, th[b]): (1, th[b]), (1, th[a]): (1, th[a]), (3, th[a]): (1, th[a]), (3, th[near]): (1, th[a])}


def test_jaccard_opens_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", 2000)
    monkeypatch.setattr(jaccard, "QUERY_GRAMS", 900)
    monkeypatch.setattr(jaccard, "COPIES", 3)
    base, rows = words(7, 300).split(), []
    for k in range(30):
        r, w = random.Random(k), list(base)
        for _ in range(k % 12):
            w[r.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w), "en", "s", 1))
    rows += [(100 + k, rows[5][1], "en", "s", 1) for k in range(20)]
    got, want = pairs_of(jaccard.join(spark.createDataFrame(rows, DOCS)).collect()), brute_pairs(rows)
    assert set(got) == set(want) and len(want) > 500
    kept = {r.keeper for r in jaccard.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(kept) == len(rows) - len({b for _, b in want})


def brute_links(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    """{doc_id: (class, links)}; a doc_id may have several texts."""
    sets, near = {}, {r[0]: set() for r in rows if r[0] is not None}
    for doc, text in {(r[0], r[1]) for r in rows if r[0] is not None}:
        w = re.findall(textvec.TERM_PATTERN, (text or "").lower())
        if w:
            sets[doc, text] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}
    for ((a, _), x), ((b, _), y) in itertools.combinations(sets.items(), 2):
        if a != b and len(x & y) >= t * len(x | y):
            near[a].add(b)
            near[b].add(a)
    root = {x: x for x in near}
    for _ in root:
        for a, b in ((a, b) for a in near for b in near[a]):
            root[a] = root[b] = min(root[a], root[b])
    return {x: (root[x], len(near[x])) for x in near}


def links_of(out):
    assert out.columns == ["doc_id", "class_id", "links"]
    rows = out.collect()
    got = {r.doc_id: (r.class_id, r.links) for r in rows}
    assert len(got) == len(rows)
    return got


def near_copies(seed, copies):
    """Different texts of one cluster, some of them several times, and texts of their own."""
    base, rows = words(seed, 300).split(), []
    for k in range(30):
        r, w = random.Random(k), list(base)
        for _ in range(k % 12):
            w[r.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w), "en", "s", 1))
    return rows + [(100 + k, rows[5][1], "en", "s", 1) for k in range(copies)] + [(900 + k, words(200 + k, 50), "en", "s", 1) for k in range(5)]


def test_jaccard_query_has_a_row_for_each_document(spark, tmp_path):
    """Clusters of copies and near copies, one five times the other: rows are those of the input, and no link is lost from the counts."""
    for copies in (10, 200):
        rows = near_copies(7, copies)
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / f"{copies}/documents.parquet"))
        got = links_of(registry.QUERIES["op3_ngram_jaccard"](spark, str(tmp_path / str(copies))))
        assert got == brute_links(rows) and len(got) == len(rows)
        assert sum(k for _, k in got.values()) == 2 * len(brute_pairs(rows)) > 100 * copies


def test_jaccard_links_equal_brute_force(spark, docs, none, rows):
    want = brute_links(rows)
    assert want[13] == (13, 0) and want[14] == (14, 0) and want[2] == (2, 2) and want[16] == (15, 1)
    clash = docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("th", "sid", "sno", "links", "weight", "class_id", "odd", "root")])
    for df in (docs, clash):
        assert links_of(jaccard.linked(df)) == want
    assert jaccard.linked(none).count() == 0
    assert links_of(jaccard.linked(docs.where("doc_id in (13, 14)"))) == {13: (13, 0), 14: (14, 0)}


def test_jaccard_links_of_split_groups_and_doc_ids_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", 2000)
    monkeypatch.setattr(jaccard, "QUERY_GRAMS", 900)
    rows = near_copies(7, 20)
    assert links_of(jaccard.linked(spark.createDataFrame(rows, DOCS))) == brute_links(rows)
    a, b, near = words(1, 60), words(2, 60), words(1, 60) + " tail"
    few = [(1, a), (1, b), (2, b), (3, near), (3, a), (4, b), (1, a), (5, words(5, 9)), (6, None), (6, a)]
    many = [(r[0], r[1]) for r in rows] + [(3, rows[9][1]), (3, rows[0][1]), (904, rows[2][1]), (100, rows[-1][1]), (7, ""), (101, a), (300, a), (300, b), (301, b), (301, rows[4][1])]
    for both in (few, many):
        assert links_of(jaccard.linked(spark.createDataFrame(both, "doc_id long, text string"))) == brute_links(both)


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(20, 60)] + [(r.randrange(15), r.randrange(15)) for _ in range(9)] + [(100, 100)]
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_reshard(spark, docs, none, rows, tmp_path):
    out, plan = sharding.reshard(docs.withColumn("moved", F.lit(1)), blocks=8)
    got = out.collect()
    assert len(got) == len(rows) and {r.new_shard for r in got} <= set(plan["capacities"])
    size = {}
    for r in got:
        assert r.moved == (r.old_shard != r.new_shard)
        size[r.new_shard] = size.get(r.new_shard, 0) + len((r.text or "").encode()) + 16
    blocks = {}
    for r in got:
        blocks[r.old_shard, r.block] = blocks.get((r.old_shard, r.block), 0) + len((r.text or "").encode()) + 16
    assert all(size[s] <= plan["capacities"][s] + max(blocks.values()) for s in size)
    assert plan["must_move"] == sum(max(0, n - plan["capacities"].get(s, 0)) for s, n in plan["sizes"].items())
    folder = f"file://{tmp_path}/shards"
    data = sharding.rewrite(out, plan, folder)
    manifest = sharding.read_manifest(folder)
    touched = [r for r in got if r.new_shard in manifest["affected"]]
    assert spark.read.parquet(data).count() == len(touched) and not set(manifest["untouched"]) & set(manifest["affected"])
    empty, plan = sharding.reshard(none)
    assert empty.count() == 0 and plan["flow"] == {}
    sharding.rewrite(empty, plan, f"file://{tmp_path}/none")


def held_tokens(bins):
    held = {}
    for b in bins:
        for d, at, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            held.setdefault(d, []).append((at, n))
    return held


def test_packing(spark, docs, none, rows):
    coder = bpe.Coder.of(bpe.VOCABULARY)
    bins = packing.pack(docs.withColumn("g", F.lit("clash")).withColumn("n", F.lit(1)), capacity=512, group_docs=8).collect()
    assert all(sum(b.lengths) == b.used <= 512 and b.slack == 512 - b.used for b in bins) and len({b.bin_id for b in bins}) == len(bins)
    want = {}
    for r in rows:
        n = len(coder.one(r[1])) if r[1] else 0
        want.setdefault(r[0], []).extend([(at, min(512, n - at)) for at in range(0, n, 512)])
    assert {k: sorted(v) for k, v in held_tokens(bins).items()} == {k: sorted(v) for k, v in want.items() if v} and packing.pack(none).count() == 0
    # a table of nulls and zeros has no bins; ties are packed once each; the caller's lengths count
    empty = spark.createDataFrame([(None, None, 0), (1, None, None), (2, "", -3)], "doc_id long, text string, len int")
    assert packing.pack(empty).count() == packing.pack(empty, length="len").count() == 0
    ties = spark.createDataFrame([(k, "x", 256) for k in range(9)], "doc_id long, text string, len int")
    got = packing.pack(ties, capacity=512, length="len").collect()
    assert len(got) == 5 and sorted(d for b in got for d in b.doc_ids) == list(range(9))


def brute_pack(lengths, capacity):
    """Minimum bin slack by trying every subset that holds the longest piece."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        top, rest = left[0], left[1:]
        best = max((sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) <= capacity - top), default=0)
        chosen = next(c for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) == best)
        bins.append(top + best)
        for x in (top, *chosen):
            left.remove(x)
    return bins


def test_packing_equals_brute_force(spark):
    r = random.Random(2)
    for _ in range(3):
        lengths = [r.randint(1, 60) for _ in range(11)]
        df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, n int")
        got = sorted((b.used for b in packing.pack(df, capacity=64, length="n").collect()), reverse=True)
        # the first bin is the fullest that holds the longest piece; later ones depend on which of equal sums was taken
        assert sum(got) == sum(lengths) and brute_pack(lengths, 64)[0] in got and len(got) <= len(brute_pack(lengths, 64)) + 1


def test_webp_column(spark):
    im = np.arange(12, dtype=np.uint32).reshape(3, 4) | np.uint32(0xFF000000)
    raw = webp.encode(im, predictor=11)
    df = spark.createDataFrame([(1, bytearray(raw), "x"), (1, bytearray(raw), "x"), (2, None, "y"), (3, bytearray(raw[:20]), "z")], "id int, image binary, width string")
    got = {r.id: r for r in webp.decode_column(df).collect()}
    assert got[1].pixels == im.ravel().tolist() and (got[1].width, got[1].height, got[1].error) == (4, 3, None)
    assert got[2].pixels is None and got[3].pixels is None and got[3].error
    assert webp.decode_column(df.limit(0)).count() == 0
    v = spark.createDataFrame([(0, [0.5] * 8), (1, None), (2, [])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.width for r in webp.decode_column(webp.thumbnails(v)).collect()} == {0: 8, 1: None, 2: None}


def test_reshard_of_odd_ids(spark):
    """An outlying id, dense clusters, a null shard and a hot source: blocks stay small in bytes, so no new shard is far over its capacity."""
    rows = [(k, "x" * (20 + k % 60), f"src{k % 3}" if k % 5 else None) for k in range(3000)] + [(1 << 60, "far", "src1"), (None, "y" * 50, "src2"), (-(1 << 60), "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'a' as old_shard", "'b' as block", "'c' as new_shard", "'d' as moved", "'e' as bytes")
    out, plan = sharding.reshard(df, blocks=64)
    got = out.collect()
    assert len(got) == len(rows) and all(r.bytes == "e" for r in got) and {r.old_shard for r in got} == {"", "src0", "src1", "src2"}
    sizes, held = {}, {}
    for r in got:
        n = len(r.text) + 16
        sizes[r.old_shard, r.block] = sizes.get((r.old_shard, r.block), 0) + n
        held[r.new_shard] = held.get(r.new_shard, 0) + n
    total = {a: sum(n for (x, _), n in sizes.items() if x == a) for a in plan["sizes"]}
    assert total == plan["sizes"] and all(n < 4 * total[a] / 64 for (a, _), n in sizes.items())
    assert plan["overrun"] == max(0, *(n - plan["capacities"][s] for s, n in held.items())) <= max(sizes.values())
    assert plan["moved"] == sum(len(r.text) + 16 for r in got if r.moved) <= plan["must_move"] + len(plan["sizes"]) * max(sizes.values())
    with pytest.raises(ValueError):
        sharding.reshard(df, capacities={"src0": 10})
    with pytest.raises(ValueError):
        sharding.reshard(df.withColumn("doc_id", F.col("text")))


PAGES = [(k, f"http://h{k % 5}.example.org/{k}", f"<p>{words(k, 40)}</p>") for k in range(60)] + [(60, None, "x"), (61, "no address", None), (None, "http://h1.example.org/z", ""), (3, "http://h3.example.org/3", f"<p>{words(3, 40)}</p>")]


def test_warc_is_deterministic(spark, tmp_path):
    seen = []
    for k, parts in enumerate((1, 5)):
        folder = f"file://{tmp_path}/w{k}"
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(parts).withColumn("file", F.lit("clash"))
        index = warc.write(df, folder, roll=3000, range_bytes=4000).collect()
        files = {p.name: p.read_bytes() for p in (tmp_path / f"w{k}").glob("*.warc.gz")}
        manifest = json.loads((tmp_path / f"w{k}" / "manifest.json").read_text())
        assert {f["file"] for f in manifest["files"]} == set(files) and sum(f["records"] for f in manifest["files"]) == len(PAGES) == len(index)
        for r in index:
            (_, size, head, _), *_ = warc.records(files[r.file][r.record_start :][: r.record_bytes])
            assert size == r.record_bytes and head["WARC-Payload-Digest"] == r.payload_digest and head.get("WARC-Target-URI", "").replace("%20", " ") == (r.url or "")
        seen.append(files)
        # read independently of the module: each file is a gzip stream of whole records whose digests fit
        for raw in files.values():
            for block in gzip.decompress(raw).split(b"WARC/1.1\r\n")[1:]:
                head, _, body = block.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
                body = body[: int(fields["Content-Length"])]
                assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                if fields["WARC-Type"] == "response":
                    payload = body.partition(b"\r\n\r\n")[2]
                    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() and b"Content-Length: %d\r\n" % len(payload) in body
        key = lambda u: (",".join(reversed(urlparse(u).netloc.split("."))) + ")" + urlparse(u).path) if u and "://" in u else u or ""
        order = [key(r.url) for r in sorted(index, key=lambda r: (r.file, r.record_start))]
        assert order == sorted(order)
    assert seen[0] == seen[1] and len(seen[0]) > 3
    large = spark.createDataFrame([(1, "http://a.org/1", "x"), (2, "http://a.org/2\x01\n", words(5, 3000)), (3, "http://a.org/3", "y")], "page_id long, url string, html string")
    index = warc.write(large, f"file://{tmp_path}/large", roll=1000).orderBy("page_id").collect()
    assert len({r.file for r in index}) == 3 and index[1].record_bytes > 1000
    raw = (tmp_path / "large" / index[1].file).read_bytes()[index[1].record_start :]
    assert b"http://a.org/2%01%0A\r\n" in gzip.decompress(raw)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(empty, f"file://{tmp_path}/e").count() == 0 and json.loads((tmp_path / "e" / "manifest.json").read_text())["files"] == []


def test_imatch(spark, none):
    rows = [(k, words(k % 30, 50)) for k in range(120)] + [(200, None), (201, ""), (202, "unique words only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_terms", F.lit("clash"))
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    assert len(got) == len(rows) and all(got[k].sig_all == got[k + 30].sig_all is not None for k in range(90))
    assert got[0].sig_all != got[1].sig_all and [got[k].n_terms for k in (200, 201, 202)] == [0, 0, 0] and got[202].sig_all is None
    joined = {r.doc_id: r for r in imatch.fingerprints(df, broadcast_terms=0).collect()}
    assert joined == got
    assert imatch.fingerprints(none).count() == 0


def test_imatch_of_a_long_text(spark):
    """Of texts longer than a slice of work, only the terms count: the same ones in another order, many times over, have equal hashes."""
    common = [f"c{k}" for k in range(40)]
    long = " ".join(common * 12_000)
    rows = [(0, long), (1, " ".join(reversed(common)))] + [(k, f"other{k} words{k} " + common[k % 40]) for k in range(2, 60)]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > textvec.SLICE_BYTES and got[0].sig_all == got[1].sig_all and got[0].n_terms == got[1].n_terms


def test_imatch_near_copies(spark, none):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(r.sample(vocabulary, 80))) for k in range(300)]
    near = [(k + 1000, " ".join(["other", "new", "terms", *text.split()[3:]])) for k, text in rows[:60]]
    rest = [(2000, None), (2001, ""), (2002, "only words of this one"), (2003, "this one of words only")]
    df = spark.createDataFrame(rows + near + rest, "doc_id long, text string")
    got = {x.doc_id: x.hashes for x in imatch.near_hashes(df).collect()}
    assert len(got) == len(rows) + len(near) + len(rest) and sum(bool({*got[k]} & {*got[k + 1000]}) for k in range(60)) >= 57
    assert not any({*got[a]} & {*got[b]} for a in range(300) for b in range(a))
    assert got[2000] == got[2001] == [] and got[2002] == got[2003] and len(got[2002]) == 1
    assert {x.doc_id: x.hashes for x in imatch.near_hashes(df, broadcast_terms=0).collect()} == got
    assert imatch.near_hashes(none).count() == 0


def test_pii(docs, none, rows):
    got = pii.pseudonymize(docs.withColumn("n_pii", F.lit("clash")), b"k").collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.n_pii:
            assert r.n_pii == 2 and "jo.do" not in r.text and pii.reveal(r.text, b"k") == text[r.doc_id]
        else:
            assert r.text == text[r.doc_id]
    assert sum(bool(r.n_pii) for r in got) == 1 and pii.pseudonymize(none, b"k").count() == 0


def test_language(spark, none):
    vocab = {"en": "the of and thing other", "de": "der und nicht schön heit"}
    rows = [(k, words(k, 3) + " " + " ".join(random.Random(k).choices(vocab[x].split(), k=25)), x) for k, x in enumerate(["en", "de"] * 30)]
    rows += [(100, None, "en"), (101, "", None), (102, "?? 12", "de"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("accepted", F.lit("clash"))
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 100:
            assert r.pred_lang == r.lang and r.accepted
        else:
            assert r.pred_lang == "und" and not r.accepted
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_key_filters(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    keys = spark.createDataFrame([(2,), (2,), (9,)], "k long")
    for limit in (0, 100):
        assert [r.k for r in among(a, keys, "k", limit).collect()] == [2]
        assert sorted(r.k or 0 for r in without(a, keys, "k", limit).collect()) == [0, 1]


def test_registry_names():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in registry.QUERIES) == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)
