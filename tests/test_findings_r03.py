"""Cases of the third round's findings."""

import difflib
import random

from lumenq.operators import bm25, chunking, evaluate, postings, retrieve
from lumenq.sources import markup


def test_alignment_compares_whole_texts(spark, monkeypatch):
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.randint(2, 6))) for _ in range(n))

    tail = words(90)
    texts = [words(rng.randint(1, 60)) for _ in range(60)] + [words(120)[:500] + tail, words(40) + tail, ""]
    proof = [("q0", "p", tail), ("q1", "p", texts[7][3:] + "z"), ("q2", "p", "é"), ("q3", "o", tail), ("q4", "p", ""), ("q1", "p", words(50))]
    chunks = spark.createDataFrame([("p", f"c{i}", i, t) for i, t in enumerate(texts)], "paper_id string, chunk_id string, ordinal long, text string").repartition(3)
    want = set()
    for q, p, e in proof:
        s = [difflib.SequenceMatcher(None, e, t, autojunk=False).ratio() for t in texts] if p == "p" else []
        if s and max(s) >= evaluate.ALIGN:
            want.add((q, f"c{s.index(max(s))}"))
    asked = spark.createDataFrame(proof, "qid string, paper_id string, evidence string")
    assert {("q0", "c61"), ("q1", "c7"), ("q4", "c62")} <= want
    assert {tuple(r) for r in evaluate.fuzzy_qrels(asked, chunks).collect()} == want
    monkeypatch.setattr(evaluate, "MAX_EVIDENCE", 0)
    assert {tuple(r) for r in evaluate.fuzzy_qrels(asked, chunks).collect()} == want


def odd_chunks(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta of İx Kelvin K9 don't é 12".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(70)] + [None, "", "...", "of of of"]
    return spark.createDataFrame([(f"c{i}", i, t, None if i == 3 else "ab"[i % 2]) for i, t in enumerate(texts)], "chunk_id string, ordinal long, text string, source string")


def asked_of(spark):
    return spark.createDataFrame([("1", "alpha of of", "a"), ("2", "zeta", "a"), ("3", None, "b"), ("4", "x K9 kelvin don", "b"), ("5", "i 12 beta", "b"), ("6", "gamma", None)], "qid string, text string, source string")


def same(a, b, *by):
    def key(r):
        return [r[c] for c in ("qid", "chunk_id", "rank", *by)], round(r.score, 8)

    return sorted(map(key, a.collect()), key=repr) == sorted(map(key, b.collect()), key=repr)


def test_search_of_sharing_chunks_joins_no_postings(spark, monkeypatch):
    chunks, q = odd_chunks(spark).repartition(3), asked_of(spark)
    monkeypatch.setattr(postings, "LOT", 200)
    for k in (1, 4, 100):
        for distinct in (False, True):
            fast = bm25.best_sharing(chunks, q, k, distinct=distinct)
            assert "MapInArrow" in fast._jdf.queryExecution().toString() and "Join" not in fast._jdf.queryExecution().toString()
            assert same(bm25.top(fast, k), bm25.top(bm25.scores(chunks, q, distinct=distinct), k))
            fast = bm25.best_sharing(chunks, q, k, ("source",), distinct)
            assert same(bm25.top(fast, k), bm25.top(bm25.scores(chunks, q, ("source",), distinct=distinct), k), "source")


def test_best_papers_equal_paper_scores(spark, monkeypatch):
    rng = random.Random(8)
    words = "alpha beta gamma delta of the epsilon zeta method".split()
    some = lambda n: " ".join(rng.choices(words, k=n))
    chunks = spark.createDataFrame([(f"c{i}", i, None if i == 5 else f"p{rng.randrange(14)}", some(rng.randint(0, 9))) for i in range(90)], "chunk_id string, ordinal long, paper_id string, text string").repartition(4)
    papers = spark.createDataFrame([(f"p{i}", i, None if i == 2 else some(2), some(rng.randint(0, 5))) for i in range(12)] + [("none", 99, "zeta", None)], "paper_id string, ordinal long, title string, abstract string")
    q = spark.createDataFrame([("1", "alpha of of"), ("2", "the method"), ("3", "zeta epsilon"), ("4", "nothing"), ("5", "of")], "qid string, text string")
    monkeypatch.setattr(postings, "LOT", 150)

    def key(rows):
        return sorted((r.qid, r.paper_id, r["rank"], round(r.score, 8)) for r in rows)

    fast = retrieve.best_papers(bm25.Index(chunks), papers, q, 3)
    assert key(fast.collect()) == key(retrieve.paper_scores(bm25.scores(chunks, q, keep=("paper_id",)), papers, q, 3).collect())
    parts = postings.best_of_groups(bm25.Index(chunks).rows("paper_id"), "paper_id", bm25.Index(chunks).sides(q)[""], bm25.K1, bm25.B)
    assert "Join" not in parts._jdf.queryExecution().toString()  # no row for each question and chunk


def test_lots_hold_few_bytes_of_long_batches():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 5000, 30, 30, 0, 9000)] + [None, "y" * 1500] * 9
    b = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts, "l": [["a"]] * len(texts)})
    cut = list(postings.lots(iter([b, b.slice(0, 0)]), 4000))
    assert pa.Table.from_batches(cut).to_pydict() == b.to_pydict()
    assert len(cut) > 4 and all(x.num_rows == 1 or sum(len(t or "") for t in x.column("text").to_pylist()) <= 13_000 for x in cut)


def test_documents_are_merged_and_split_in_lots(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"c{d}-{i}", d, i, f"s{i // 4}", "table" if rng.random() < 0.1 else "paragraph", "w" * rng.randint(1, 120)) for d in range(25) for i in range(rng.randint(1, 12))]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, ordinal long, section string, chunk_type string, text string").repartition(5)
    merged = chunking.merge_short(chunks)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()
    want = []
    for d in range(25):
        want += [(x["chunk_id"], x["text"]) for x in chunking.merge_rows([dict(zip(chunks.columns, r, strict=True)) for r in rows if r[1] == d])]
    assert sorted((r.chunk_id, r.text) for r in merged.collect()) == sorted(want)
    long = [(str(i), i, ". ".join("z" * rng.randint(5, 700) for _ in range(i))) for i in range(12)]
    split = chunking.split_long(spark.createDataFrame(long, "chunk_id string, ordinal long, text string"))
    assert "MapInPandas" not in split._jdf.queryExecution().toString()
    want = [(c, n, t) for c, _, text in long for n, t in enumerate(chunking.split_text(text))]
    assert sorted((r.chunk_id, r.piece, r.text) for r in split.collect()) == sorted(want)


def test_pages_are_parsed_in_lots(spark):
    pages = [(i, f"<body><h1>H{i}</h1>" + "".join(f"<p>text {i} {k}</p>" for k in range(i))) for i in range(9)] + [(9, None)]
    got = markup.parse_html(spark.createDataFrame(pages, "page_id long, html string"))
    assert "MapInPandas" not in got._jdf.queryExecution().toString()
    want = [(i, c["chunk_id"], c["ordinal"], c["section"], c["text"]) for i, h in pages for c in markup.html_document(h)]
    assert sorted((r.page_id, r.chunk_id, r.ordinal, r.section, r.text) for r in got.collect()) == sorted(want)
