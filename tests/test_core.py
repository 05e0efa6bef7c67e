"""Behaviour of retrieval, routing, numbers, verification, evaluation and the agent, by hand-made and brute-force cases."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenq.functions import rules as R
from lumenq.functions import text as X
from lumenq.operators import agent, bm25, chunking, dense, evaluate, fusion, judge, numeric, postprocess, prompt, rerank, retrieve, rewrite, router, verify
from lumenq.sources import markup, papers, runs
from lumenq.streaming import feedback


def routed(spark, *questions):
    df = spark.createDataFrame([(q,) for q in questions], "question string")
    return {r.question: r.plan for r in router.route_table(df).collect()}


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("Été F1-score, a12 x 1-2 1,234.5%",), (None,)], "t string")
    got = df.select(X.tokens(F.col("t")).alias("a"), X.numbers(F.col("t")).alias("n")).collect()
    text = "Été F1-score, a12 x 1-2 1,234.5%"
    assert got[0].a == re.findall("[a-z0-9]+", text.lower()) and got[0].n == re.findall(X.NUMBER, text) == ["2", "1", "-2", "1,234.5%"]
    assert got[1].a == []


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [re.findall("[a-z0-9]+", d.lower()) for d in docs]
    mean, df = sum(map(len, toks)) / len(toks), {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return [sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / mean)) for w in re.findall("[a-z0-9]+", query.lower())) for t in toks]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    docs = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "common"], k=r.randint(3, 12)) + ["common"]) for _ in range(12)]
    rows = [(f"c{i}", i, d, "ab"[i % 2]) for i, d in enumerate(docs)]
    return docs, spark.createDataFrame(rows, "chunk_id string, ordinal long, text string, source string")


def test_bm25_equals_okapi(spark, corpus):
    docs, chunks = corpus
    asked = ["alpha common common", "zeta", "gamma delta"]
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "qid string, text string")
    got = {(r.qid, r.chunk_id): r for r in bm25.retrieve(chunks, q, 12).collect()}
    assert len(got) == 36  # chunks without a matching term are there too
    for i, t in enumerate(asked):
        want = okapi(docs, t)
        order = sorted(range(12), key=lambda k: (-round(want[k], 9), k))
        for rank, k in enumerate(order, 1):
            assert abs(got[str(i), f"c{k}"].score - want[k]) < 1e-9 and got[str(i), f"c{k}"].rank == rank
    scoped = {(r.qid, r.chunk_id): r.score for r in bm25.scores(chunks, q.crossJoin(spark.createDataFrame([("a",), ("b",)], "source string")), ("source",)).collect()}
    want = okapi([d for i, d in enumerate(docs) if i % 2 == 0], asked[0])
    assert all(abs(scoped["0", f"c{2 * k}"] - w) < 1e-9 for k, w in enumerate(want) if w)


def test_three_documents_with_the_term_score_below_zero(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, "same") for i in range(3)], "chunk_id string, ordinal long, text string")
    got = bm25.retrieve(chunks, spark.createDataFrame([("q", "same")], "qid string, text string"), 3).collect()
    assert all(abs(r.score - w) < 1e-12 and r.score < 0 for r, w in zip(got, okapi(["same"] * 3, "same"), strict=True))


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid string, chunk_id string, ordinal long, rank long, score double")


def test_rrf_sums_weights_and_breaks_ties(spark):
    a = ranked(spark, [("q", "x", 0, 1, 9.0), ("q", "y", 1, 2, 8.0)])
    b = ranked(spark, [("q", "z", 2, 1, 1.0), ("q", "x", 0, 2, 0.5)])
    got = fusion.rrf([(a, 1.0), (b, 1.0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "z", "y"] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12
    got = fusion.rrf([(a, 1.0), (b, 0.1)], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "y"]
    got = fusion.rrf([(a.where("chunk_id = 'y'").withColumn("rank", F.lit(1)), 1.0), (b.where("chunk_id = 'z'"), 1.0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "z"]  # equal scores: the first list's comes first


def test_rewrite_rescues_a_candidate(spark):
    rows = spark.createDataFrame([("q", 0, "a", 0, 1), ("q", 0, "b", 1, 2), ("q", 1, "c", 2, 1), ("q", 1, "b", 1, 2)], "qid string, variant int, chunk_id string, ordinal long, rank long")
    got = fusion.multi_query_rrf(rows, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and abs(got[2].score - 0.7 / 61) < 1e-12


def test_caps_reorder_and_drop_nothing(spark):
    rows = spark.createDataFrame([("q", f"c{i}", i, i + 1, 1.0, s) for i, s in enumerate("aaabb")], "qid string, chunk_id string, ordinal long, rank long, score double, section string")
    got = fusion.capped(rows, "section", 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c3", "c4", "c2"]


def test_union_and_neighbours(spark):
    a, b = ranked(spark, [("q", "x", 0, 1, 1.0), ("q", "", 3, 2, 1.0)]), ranked(spark, [("q", "y", 1, 1, 1.0), ("q", "x", 0, 2, 1.0)])
    assert [r.chunk_id for r in fusion.ordered_union([a, b]).orderBy("rank").collect()] == ["x", "y"]
    chunks = spark.createDataFrame([(f"c{i}", i * 10, "p" if i < 3 else "o") for i in range(5)], "chunk_id string, ordinal long, doc_id string")
    got = fusion.neighbours(ranked(spark, [("q", "c1", 10, 1, 2.0)]), chunks, 2).orderBy("ordinal").collect()
    assert [(r.chunk_id, r.distance, round(r.score, 3)) for r in got] == [("c0", 1, 1.99), ("c2", 1, 1.99)]


LIST = "qid string, chunk_id string, ordinal long, rank long, score double, score_kind string, section string, chunk_type string, text string, caption string"


def listed(spark, kinds, scores=None):
    return spark.createDataFrame([("q", f"c{i}", i, i + 1, (scores or [5 - i] * 9)[i] * 1.0, "pair", f"s{i}", k, f"words {k}", f"cap{i}") for i, k in enumerate(kinds)], LIST)


def plan(spark, kind, cross=False, yes_no=False):
    return spark.createDataFrame([("q", kind, cross, yes_no)], "qid string, query_type string, cross_table boolean, is_yes_no boolean")


def tables(spark, scores=(0.5, 0.2)):
    return spark.createDataFrame([("q", f"t{i}", 90 + i, i + 1, s, "bm25", "t", "table", f"| {i} |", f"T{i}") for i, s in enumerate(scores)], LIST)


def test_tables_are_injected(spark):
    p6 = ["paragraph"] * 6
    got = postprocess.with_table(listed(spark, p6), tables(spark, (-1.0,)), plan(spark, "numerical"), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["t0", "c0", "c1", "c2", "c3"] and got[0].score_kind == "bm25"
    got = postprocess.with_table(listed(spark, p6), tables(spark, (-1.0,)), plan(spark, "comparison"), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2", "c3", "c4"]
    got = postprocess.with_table(listed(spark, p6), tables(spark), plan(spark, "comparison"), 1).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["t0", "c0"]
    got = postprocess.with_table(listed(spark, ["table", *p6]), tables(spark), plan(spark, "numerical"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2"]


def test_two_tables_merge(spark):
    got = postprocess.with_merged_tables(listed(spark, ["paragraph", "table", "paragraph"]), tables(spark), plan(spark, "comparison", True)).orderBy("rank").collect()
    assert got[0].chunk_type == "merged_tables" and got[0].chunk_id == "c1+t0" and got[0].caption == "cap1 vs. T0" and "\n\n---\n\n" in got[0].text and [r.chunk_id for r in got[1:]] == ["c0", "c2"]
    got = postprocess.with_merged_tables(listed(spark, ["paragraph", "table"]), tables(spark), plan(spark, "comparison")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1"]


def test_confidence_boost_and_k(spark):
    low = lambda rows, p: postprocess.with_confidence(rows, p).where("rank = 1").first().low_confidence
    assert low(listed(spark, ["paragraph"], [-0.1]), plan(spark, "factual")) and not low(listed(spark, ["paragraph"], [0.1]), plan(spark, "factual"))
    assert low(listed(spark, ["paragraph"], [1]), plan(spark, "numerical")) and low(listed(spark, ["paragraph"], [1]), plan(spark, "comparison")) and low(listed(spark, ["paragraph"] * 2, [1, 1]), plan(spark, "comparison", True))
    rows = listed(spark, ["paragraph"] * 2, [1.0, 0.8]).withColumn("section", F.when(F.col("rank") == 2, "Training setup").otherwise("Modelling"))
    assert [r.chunk_id for r in postprocess.boosted(rows, plan(spark, "methodology")).orderBy("rank").collect()] == ["c1", "c0"]
    assert [r.chunk_id for r in postprocess.boosted(rows, plan(spark, "factual")).orderBy("rank").collect()] == ["c0", "c1"]
    ks = spark.createDataFrame([("why_how", False), ("factual", True), ("factual", False)], "t string, y boolean").select(postprocess.effective_k(F.col("t"), F.col("y"), 5).alias("k")).collect()
    assert [r.k for r in ks] == [7, 8, 5]


def test_full_postprocess(spark):
    got = postprocess.postprocess(listed(spark, ["paragraph"] * 9, [9, 8, 7, 6, 5, 4, 3, 2, 1]), tables(spark), plan(spark, "numerical", yes_no=True)).orderBy("rank").collect()
    assert len(got) == 8 and got[0].chunk_id == "t0" and got[0].low_confidence is False and got[1].low_confidence is None


def test_plans(spark):
    asked = {"How many papers were used?": "numerical", "Compare BERT with GPT on speed": "comparison", "Who wrote the corpus?": "factual", "Why does dropout help?": "why_how", "Which decoder is used?": "methodology", "有多少篇论文": "numerical"}
    plans = routed(spark, *asked)
    assert {q: p.query_type for q, p in plans.items()} == asked
    p = plans["How many papers were used?"]
    assert (p.evidence_need, p.answer_style, p.source_preference, p.route_level) == ("table_or_numeric_sentence", "numeric_with_units", ["table", "paragraph"], "small_router")
    p = plans["Compare BERT with GPT on speed"]
    assert p.comparison_entities == ["BERT", "GPT"] and p.evidence_need == "two_sided_evidence" and p.retrieval_strategy == "decompose" and p.complexity_score > 0.5
    assert (plans["Who wrote the corpus?"].retrieval_strategy, plans["Who wrote the corpus?"].evidence_need) == ("standard", "single_chunk")
    p = routed(spark, "Which figure shows why A is better than B?")["Which figure shows why A is better than B?"]
    assert p.confidence_checks[0] == "warn_if_figure_missing" and p.cross_table and p.evidence_need == "two_tables"


def test_classifiers_differ_in_precedence(spark):
    q = F.lit("Why is the encoder frozen?")
    row = spark.range(1).select(R.classify(q, R.BENCH_RULES).alias("b"), R.classify(q).alias("a"), R.found(q, R.YES_NO).alias("y"), R.found(F.lit("Is it so?"), R.YES_NO).alias("z"), R.classify(F.lit(None).cast("string")).alias("n")).first()
    assert (row.b, row.a, row.y, row.z, row.n) == ("why_how", "methodology", False, True, "factual")


def test_synthetic_questions_are_routed(spark):
    q = router.synthetic_questions(spark)
    assert q.count() == 500 and q.select("question").distinct().count() == 500
    assert q.where(R.classify(F.col("question")) != F.col("label")).count() == 0


def test_semantic_override(spark):
    df = spark.createDataFrame([("Tell me about it", "why_how", 0.6, 0.2), ("Tell me about it", "why_how", 0.5, 0.2), ("Tell me about it", "comparison", 0.9, 0.5), ("How many?", "why_how", 0.9, 0.9), ("Tell me", None, None, None)], "q string, l string, s double, m double")
    got = df.select(router.route_with_model(F.col("q"), F.col("l"), F.col("s"), F.col("m")).alias("p")).collect()
    assert [r.p.query_type for r in got] == ["why_how", "factual", "comparison", "numerical", "factual"]
    assert got[0].p.route_level == "small_router_model" and got[2].p.evidence_need == "two_sided_evidence"


def test_planner_replies(spark):
    replies = ['```json\n{"query_type": "numerical", "source_preference": ["paragraph", "video"], "rewrite_queries": ["a", " a ", "b"], "hyde_query": " h "}\n```', "nothing", '{"query_type": "poem", "is_yes_no": true}', '{"query_type": "comparison", "cross_table": true, "comparison_entities": ["x", "y"]}']
    df = spark.createDataFrame([(r,) for r in replies], "raw string").select(router.coerced(F.lit("Tell me"), F.col("raw"), router.route(F.lit("Tell me"))).alias("p"))
    a, b, c, d = [r.p for r in df.collect()]
    assert (a.source_preference, a.rewrite_queries, a.hyde_query, a.evidence_need, a.route_level) == (["table", "paragraph"], ["a", "b"], "h", "table_or_numeric_sentence", "large_planner")
    assert b.route_level == "small_router" and (c.query_type, c.answer_style) == ("factual", "yes_no_then_evidence") and "state_yes_no_first" in c.confidence_checks
    assert d.evidence_need == "two_tables" and d.confidence_checks[-2:] == ["require_two_tables", "require_two_sided_evidence"] and d.comparison_entities == ["x", "y"]


def test_variants(spark):
    def of(q, kind, rewrites=(), hyde="", entities=()):
        arr = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
        return spark.range(1).select(rewrite.variants(F.lit(q), F.lit(kind), arr(rewrites), F.lit(hyde), arr(entities)).alias("v")).first().v

    assert of("Who?", "factual") == ["Who?"] and len(of("Who?", "why_how")) == 5 and len(of("A summary", "factual")) == 5 and len(of("N?", "numerical")) == 3
    assert of("Who?", "numerical", ["  WHO? ", "other"], "p") == ["Who?", "other", "p"]
    assert of("A or B?", "comparison", entities=["A", "B"])[1].startswith("A or B? A B ")
    p = routed(spark, "Compare tall trees and short bushes")
    got = spark.createDataFrame([("Compare tall trees and short bushes",)], "q string").select(rewrite.decomposed(F.col("q"), router.route(F.col("q"))).alias("v")).first().v
    assert got[:2] == p["Compare tall trees and short bushes"].comparison_entities == ["tall trees", "short bushes"] and len(got) <= 6


FACT_ROWS = "qid string, chunk_id string, rank long, text string, caption string, section string, chunk_type string, table_columns array<string>, table_rows array<array<string>>"


def test_numbers_in_tables(spark):
    rows = [("q", "t", 1, "", "Scores", "s", "table", ["Model", "F1"], [["Small", "81.2"], ["Large", "83.5"], ["", " "]]), ("r", "m", 1, "Caption\n| A | B |\n|:---|---|\n| x | -1,234 % |\n| y | 5% | 7 |", None, "s", "table", None, None)]
    got = numeric.facts(spark.createDataFrame(rows, FACT_ROWS)).orderBy("qid", "seq").collect()
    assert [(r.value, r.raw_value, r.metric, r.row_label) for r in got] == [(81.2, "81.2", "F1", "Small"), (83.5, "83.5", "F1", "Large"), (-1234.0, "-1,234", "B", "x"), (5.0, "5%", "B", "y"), (7.0, "7", "", "y")]
    asked = spark.createDataFrame([("q", "Which model has the highest F1, the mean and the gap?", "numerical", True), ("r", "What?", "factual", False)], "qid string, question string, query_type string, needs_calculation boolean")
    notes = {r.qid: r.notes for r in numeric.notes(spark.createDataFrame(rows, FACT_ROWS), asked).collect()}
    assert "Candidate maximum: 83.5 at Large / F1" in notes["q"] and "Candidate average: 82.35" in notes["q"] and "Candidate difference: 2.3" in notes["q"] and notes["r"] == "None."


def test_numbers_in_texts(spark):
    rows = [("q", "p", 1, "x" * 200 + " about  12.5% of\nall a7 " + "y" * 200, None, "sec", "paragraph", None, None)]
    (a,) = [r for r in numeric.facts(spark.createDataFrame(rows, FACT_ROWS)).collect()]
    assert a.value == 12.5 and "about 12.5% of all a7" in a.metric and len(a.metric) <= 140 and a.caption == "sec"


def test_claims(spark):
    answers = spark.createDataFrame([("q", "The model reaches 83.5 points on tests [1]. It was trained with cheap hardware over weekends; tiny"), ("n", None)], "qid string, answer string")
    table = verify.claim_table(answers)
    assert [r.claim for r in table.orderBy("claim_no").collect()] == ["The model reaches 83.5 points on tests .", "It was trained with cheap hardware over weekends"]
    proof = spark.createDataFrame([("q", "a", 1, "Our model reaches 83.5 points on all tests."), ("q", "b", 2, "Nothing of note.")], "qid string, chunk_id string, rank long, text string")
    got = verify.claim_support(table, proof).orderBy("claim_no").collect()
    assert [(r.supported, r.best_chunk_id) for r in got] == [(True, "a"), (False, "")]
    for r in got:
        want = agent.check_claim(r.claim, [x.asDict() for x in proof.collect()])
        assert (want["supported"], want["best_chunk_id"], want["token_support"]) == (r.supported, r.best_chunk_id, r.token_support)
    s = verify.answer_support(verify.claim_support(table, proof)).first()
    assert (s.coverage, s.verified) == (0.5, False) and s.supported_answer.startswith("The model reaches")


def test_metrics(spark):
    lists = ranked(spark, [("a", f"c{i}", i, i + 1, 1.0) for i in range(6)] + [("b", "x", 0, 1, 1.0)])
    qrels = spark.createDataFrame([("a", "c1"), ("a", "c4"), ("a", "c5"), ("b", "zz"), ("c", "q")], "qid string, chunk_id string")
    got = {r.qid: r for r in evaluate.per_query(lists, qrels).collect()}
    a = got["a"]
    assert (a.hit1, a.hit3, a.hit5, a.mrr, a.first_gold_rank, a.all_evidence_recall5) == (0.0, 1.0, 1.0, 0.5, 2, 0.0) and abs(a.evidence_recall5 - 2 / 3) < 1e-12
    assert abs(a.ndcg5 - (1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3) + 0.5)) < 1e-12
    assert (got["b"].mrr, got["b"].first_gold_rank, got["c"].hit5) == (0.0, None, 0.0)
    s = evaluate.summary(evaluate.per_query(lists, qrels)).first()
    assert (s.n, s.median_gold_rank, round(s.hit5, 4)) == (3, 2.0, 0.3333)


def test_alignment_and_samples(spark):
    chunks = spark.createDataFrame([("p", "c0", 0, "the quick brown fox"), ("p", "c1", 1, "something else entirely"), ("o", "c2", 0, "the quick brown fox")], "paper_id string, chunk_id string, ordinal long, text string")
    proof = spark.createDataFrame([("q", "p", "the quick brown foxes"), ("r", "p", "zzzz")], "qid string, paper_id string, evidence string")
    assert [tuple(r) for r in evaluate.fuzzy_qrels(proof, chunks).collect()] == [("q", "c0")]
    long = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([("d1", f"intro {long} end"), ("d2", "short text"), ("d3", long[:-1])], "chunk_id string, text string")
    q = spark.createDataFrame([("a", long), ("b", "short")], "qid string, text string")
    assert {tuple(r) for r in evaluate.exact_qrels(q, docs).collect()} == {("a", "d1"), ("b", "d2")}
    rows = spark.createDataFrame([(str(k), "xy"[k % 2]) for k in range(50)], "qid string, kind string")
    assert {r.kind: r["count"] for r in evaluate.stratified(rows, "kind", 10).groupBy("kind").count().collect()} == {"x": 10, "y": 10}


def test_judge(spark):
    replies = ['```json\n{"score": 5, "verdict": "FULLY_SUFFICIENT"}\n```', 'so {"score": 3} ok', "none", '{"score": 9}', '{"score": "x", "missing_facts": "one"}']
    got = [r.j for r in spark.createDataFrame([(r,) for r in replies], "raw string").select(judge.judgement(F.col("raw")).alias("j")).collect()]
    assert [(j.score, j.verdict) for j in got] == [(5, "FULLY_SUFFICIENT"), (3, "PARTIALLY_SUFFICIENT"), (1, "INSUFFICIENT"), (5, "FULLY_SUFFICIENT"), (1, "INSUFFICIENT")]
    assert got[2].missing_facts == ["judge_parse_error"] and got[4].missing_facts == ["one"]
    rows = spark.createDataFrame([("q", "w?", "alpha beta gamma", "alpha beta gamma delta", 0.0, 0.0), ("r", "w?", "alpha beta gamma", "", 0.0, 0.0)], "qid string, question string, reference_answer string, context string, hit5 double, mrr double")
    first, bad = judge.two_pass(rows)
    assert {r.qid: r.verdict for r in first.collect()} == {"q": "FULLY_SUFFICIENT", "r": "INSUFFICIENT"} and [(r.qid, r.category, r.fixable) for r in bad.collect()] == [("r", "MISSING_EVIDENCE", False)]


def chunk(cid, text="words", kind="paragraph", section="s"):
    return {"chunk_id": cid, "text": text, "chunk_type": kind, "section": section, "score": 1.0}


def scripted(*turns):
    it = iter(turns)
    return lambda *_: next(it, [])


def call(name, **args):
    return {"name": name, "arguments": args}


def names(out):
    return [t["name"] for t in out["trace"]]


def test_agent_paths():
    tools = agent.Tools(lambda q, k: [chunk("p1", "see the following"), chunk("p3")], lambda c, w: [chunk("p2")])
    out = agent.run("q", {}, tools, scripted([call("retrieve_evidence")], [call("inspect_context")], [call("finish", reason="ok")]))
    assert names(out) == ["retrieve_evidence", "inspect_context", "finish", "generate"] and [r["chunk_id"] for r in out["retrieved"]] == ["p1", "p3"]
    out = agent.run("q", {}, tools, scripted([call("retrieve_evidence")], [call("list_neighbor_chunks", chunk_id="p1")], [call("finish")]))
    assert [r["chunk_id"] for r in out["retrieved"]] == ["p1", "p2", "p3"] and "list_neighbor_chunks" in out["rounds"][1]["available_tools"]
    out = agent.run("q", {}, tools, scripted([call("retrieve_evidence"), call("finish")], []))
    assert [t["ok"] for t in out["trace"]][:2] == [True, False] and len(out["rounds"]) == 2
    out = agent.run("q", {}, tools, lambda *_: [call("rewrite_query")], max_steps=3)
    assert names(out)[-2:] == ["guardrail_pause", "generate"] and len(out["rounds"]) == 3
    out = agent.run("q", {}, tools, scripted([{"name": "retrieve_evidence", "arguments": "{bad"}], [call("no_such")], [call("finish")]))
    assert [t["ok"] for t in out["trace"]][:3] == [True, False, True]


def test_agent_tables_and_verification():
    rows = [chunk("p", "plain"), chunk("n", "has 7"), chunk("t", "| 1 |", "table")]
    tools = agent.Tools(lambda q, k: rows)
    out = agent.run("q", {"query_type": "numerical"}, tools, scripted([call("retrieve_numeric_or_table")], [call("extract_table_data")], [call("finish")]))
    assert [r["chunk_id"] for r in out["retrieved"]] == ["n", "t", "p"] and "extract_table_data" in out["rounds"][1]["available_tools"]
    plain = agent.Tools(lambda q, k: [chunk("p", "plain")])
    assert "extract_table_data" not in agent.run("q", {}, plain, scripted([call("retrieve_evidence")], [call("finish")]))["rounds"][1]["available_tools"]
    bad = call("verify_answer_support", candidate_answer="The unseen claim holds 99 items.")
    out = agent.run("q", {}, plain, scripted([call("retrieve_evidence")], [bad], [bad], [call("finish", final_answer="careful")]), prefer_verified=True)
    assert out["rounds"][2]["available_tools"][-1] == "finish" and out["rounds"][3]["available_tools"] == ["finish"] and out["answer"] == "careful"
    assert agent.run("q", {}, plain, scripted([call("retrieve_evidence")], [bad], [bad], [call("finish", final_answer="careful")]))["answer"] == "plain [1]"
    s = agent.State("q")
    s.add([chunk(str(k)) for k in range(20)])
    assert len(s.evidence) == 16 and s.add([chunk("3")]) == []


def test_agent_over_an_index_equals_the_loop_in_memory(spark):
    """Every look-up is of the whole index: each trace is that of the same loop over all chunks held in a list."""
    r = random.Random(6)
    vocabulary = "dropout helps training loss table accuracy score method reason following below above result layer 12 7.5 word".split()
    rows = []
    for doc in range(8):
        for i in range(9):
            text = " ".join(r.choices(vocabulary, k=r.randint(4, 15)))
            rows.append({"chunk_id": f"d{doc}c{i}", "ordinal": doc * 100 + i, "section": f"s{i // 3}", "chunk_type": "table" if i == 4 else "paragraph", "text": text, "doc_id": doc})
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinal long, section string, chunk_type string, text string, doc_id long")
    asked = [("a", "why dropout helps", "why_how", "retrieve_fusion", ["reason method", "loss"]), ("b", "accuracy score", "numerical", "retrieve_numeric_or_table", []), ("c", "zzz", "factual", "retrieve_evidence", []), ("d", "training loss", "comparison", "retrieve_fusion", None)]
    q = spark.createDataFrame([(i, t, k, (s,), v) for i, t, k, s, v in asked], "qid string, question string, query_type string, profile struct<suggested_start: string>, rewrites array<string>")

    def curious(s, tools, last, profile):
        """As the rules, and a neighbour list as long as one is offered."""
        if "list_neighbor_chunks" in tools:
            return [{"name": "list_neighbor_chunks", "arguments": {"chunk_id": sorted(s.near)[0]}}]
        return agent.rule_policy(s, tools, last, profile)

    place = {x["chunk_id"]: i for i, x in enumerate(rows)}

    def near(cid, w):
        i = place[cid]
        return [{**rows[j], "score": -0.01 * abs(j - i)} for j in range(i - w, i + w + 1) if j != i and 0 <= j < len(rows) and rows[j]["doc_id"] == rows[i]["doc_id"]]

    got = {x.qid: x for x in agent.run_indexed(chunks, q, policy=curious).collect()}
    assert set(got) == {"a", "b", "c", "d"} and any("list_neighbor_chunks" in x.tools for x in got.values())
    for i, t, k, start, more in asked:
        want = agent.traced(i, agent.run(t, {"query_type": k, "rewrite_queries": more}, agent.Tools(agent.local_search(rows), near), curious, profile={"suggested_start": start}))
        assert {c: got[i][c] for c in ("answer", "retrieved_ids", "tools", "n_rounds", "verified")} == {c: want[c] for c in ("answer", "retrieved_ids", "tools", "n_rounds", "verified")}
    md = runs.trace_markdown([{"qid": "a", "question": "w", "answer": "a", "rounds": got["a"].rounds}])
    assert "round 1: retrieve_fusion" in md


def test_tool_schemas_and_suggestions():
    made = {x["function"]["name"]: x["function"]["parameters"] for x in agent.schemas()}
    assert list(made) == list(agent.TOOLS) and made["list_neighbor_chunks"]["required"] == ["chunk_id"] and not made["finish"]["additionalProperties"]
    assert [x["function"]["name"] for x in agent.schemas(["finish", "unknown", "rewrite_query"])] == ["finish", "rewrite_query"]
    assert all(callable(getattr(agent.Tools, f"_{n}")) for n in agent.TOOLS)
    s = agent.State("q", {}, {"suggested_start": "retrieve_fusion", "numeric_or_table": True, "comparison": True})
    assert agent.suggestions(s, [], []) == ["start_with_retrieve_fusion"]
    s.add([chunk("a", "see the following")])
    assert agent.suggestions(s, ["a"], s.evidence) == ["retrieve_numeric_or_table_with_metric_terms", "retrieve_fusion_for_more_sections", "list_neighbor_chunks_of_an_incomplete_one"]
    s.add([chunk("b", "has 7", section="t")])
    s.expansions = 2
    assert agent.suggestions(s, ["a"], s.evidence) == ["finish_if_supported_else_rewrite_query"]


def test_prompts(spark):
    ranked = spark.createDataFrame([("q", 1, "table", "P", "S", None, "| 1 |", 0.5), ("q", 2, "merged_tables", None, None, "A vs. B", "| 2 |", -1.0), ("q", 3, "paragraph", "R", None, None, None, -2.0)], "qid string, rank long, chunk_type string, paper_id string, section string, caption string, text string, score double")
    plan = "struct<answer_style: string, confidence_checks: array<string>, comparison_entities: array<string>, evidence_need: string, source_preference: array<string>>"
    q = spark.createDataFrame([("q", "Q?", ("nonsense", ["a_b"], ["x", "y"], "two_tables", ["table"])), ("none", "N?", None)], f"qid string, question string, plan {plan}")
    got = {r.qid: r.prompt for r in prompt.prompts(q, ranked).collect()}
    assert "[1] (Paper: P; Table: S)\n| 1 |\n\n[2] (Tables side by side: A vs. B)\n| 2 |\n\n[3] (Paper: R; Section: )\n" in got["q"]
    assert prompt.POLICIES["concise_cited"] in got["q"] and "- a b\n- compare these, where supported: x, y\n- evidence need: two_tables\n- preferred sources: table" in got["q"] and prompt.SEVERAL in got["q"] and prompt.WEAK not in got["q"]
    assert prompt.NO_SOURCES in got["none"] and "use only the cited sources" in got["none"]
    facts = spark.createDataFrame([("q", "c", 1, k) for k in range(20)] + [("q", "d", 2, 0)], "qid string, chunk_id string, source_rank int, seq int")
    assert prompt.facts_by_chunk(facts).groupBy("chunk_id").count().orderBy("chunk_id").collect() == [("c", 12), ("d", 1)]


def test_agent_results(spark):
    rows = [("a", [None, "", "x", "g"], 10.0), ("b", [], 20.0), ("c", ["g"], 5.0), ("nogold", ["g"], 1.0)]
    res = spark.createDataFrame(rows, "qid string, retrieved_ids array<string>, latency_ms double")
    qrels = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("c", "h")], "qid string, chunk_id string")
    each = {r.qid: r for r in evaluate.agent_results(res, qrels).collect()}
    assert set(each) == {"a", "b", "c"} and each["a"].first_gold_rank == 2 and each["b"].mrr == 0 and each["c"].evidence_recall5 == 0.5 and each["c"].gold_ids == ["g", "h"]
    one = evaluate.agent_summary(evaluate.agent_results(res, qrels)).first()
    assert (one.n, one.mrr, one.latency_ms) == (3, 0.5, round(35 / 3, 6))
    none = evaluate.agent_summary(evaluate.agent_results(res.limit(0), qrels)).first()
    assert (none.n, none.hit5, none.latency_ms) == (0, 0.0, 0.0)


def test_answers_are_read_as_annotated(spark):
    answer = "struct<unanswerable: boolean, extractive_spans: array<string>, yes_no: boolean, free_form_answer: string, evidence: array<string>>"
    qas = [("Q1", "1", [((False, [], None, " Free ", ["e"]),), ((False, ["s", "t"], None, "", ["FLOAT SELECTED", "e", "f"]),)], "nb", None), ("Q2", "2", [((False, [], True, "", ["e"]),), ((True, None, None, None, None),)], None, None), ("Q3", "3", [((False, [], None, "", ["e"]),)], None, None), ("Q4", "4", [(None,), ((True, [], None, "", []),)], None, None), ("Q5", "5", [], None, None)]
    df = spark.createDataFrame([("p", qas)], f"paper_id string, qas array<struct<question: string, question_id: string, answers: array<struct<answer: {answer}>>, nlp_background: string, topic_background: string>>")
    got = {r.qid: r for r in evaluate.answerable_queries(df).collect()}
    assert {k: (r.answer_type, r.reference_answer, r.evidence) for k, r in got.items()} == {"p__1": ("free_form", " Free  | s; t", ["e", "f"]), "p__2": ("yes_no", "yes", ["e"]), "p__3": ("unknown", "", ["e"])}
    full = {r.qid: r for r in evaluate.annotated_questions(df).collect()}
    assert len(full) == 5 and full["p__1"].reference_answer == " Free  | s | t" and full["p__1"].answer_types == ["extractive", "free_form"] and full["p__1"].evidence == ["e", "FLOAT SELECTED", "f"]
    assert full["p__2"].answer_form_labels == ["unanswerable", "yes"] and full["p__2"].unanswerable_count == 1 and not full["p__4"].has_answer and full["p__5"].answer_types == []


def test_exact_gold_equals_a_search_of_every_pair(spark, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(r.choices("a bb ccc dd é".split(), k=r.randint(0, 30))) for _ in range(60)] + [None, ""]
    asked = [t[3:25] for t in texts[:20] if t] + ["", "a", None, texts[0], texts[0], "not there"]
    docs = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "qid string, text string")
    want = {(str(i), f"c{k}") for i, a in enumerate(asked) for k, t in enumerate(texts) if a is not None and t is not None and a in t}
    for most in (200, 0):
        monkeypatch.setattr(evaluate, "MAX_PATTERNS", most)
        got = evaluate.exact_qrels(q, docs).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_bm25_by_joins_equals_by_products(spark, corpus, monkeypatch):
    docs, chunks = corpus
    odd = chunks.unionByName(spark.createDataFrame([("n", 50, None, "a"), ("e", 51, "", "b")], chunks.schema))
    q = spark.createDataFrame([("1", "alpha common common"), ("2", "zeta"), ("3", None), ("4", "gamma delta 12"), ("4b", "")], "qid string, text string")
    for k in (1, 3, 30):
        fast = bm25.retrieve(odd, q, k).collect()
        monkeypatch.setattr(bm25, "MAX_WEIGHTS", 0)
        slow = bm25.retrieve(odd, q, k).collect()
        monkeypatch.undo()
        key = lambda r: (r.qid, r.chunk_id, r.rank, round(r.score, 9))
        assert sorted(map(key, fast)) == sorted(map(key, slow)) and len(fast) == 5 * min(k, 14)
    assert bm25.retrieve(odd.limit(0), q, 3).count() == 0 and bm25.retrieve(odd, q.limit(0), 3).count() == 0


def test_dense_by_products_equals_crossing(spark, monkeypatch):
    rows = [(str(i), i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [("null", 40, None), ("short", 41, [1.0])]
    vecs = spark.createDataFrame(rows, "chunk_id string, ordinal long, vec array<float>")
    q = spark.createDataFrame([(str(i), [1.0, float(i), -1.0]) for i in range(6)], "qid string, qvec array<float>")
    key = lambda r: (r.qid, r.chunk_id, r.rank, r.score if r.score is None else round(r.score, 9))
    fast = sorted(map(key, dense.retrieve(vecs, q, 7).collect()))
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 2)
    assert fast == sorted(map(key, dense.retrieve(vecs, q, 7).collect())) and len(fast) == 42


def test_chunk_transforms(spark):
    p = lambda t, s="a", k="paragraph": {"section": s, "text": t, "chunk_type": k}
    got = chunking.merge_rows([p("x" * 150), p("y" * 100), p("z"), p("w", "b"), p("t", "b", "table"), p("v" * 300, "b")])
    assert [len(c["text"]) for c in got] == [251, 1, 1, 1, 300]
    text = " ".join(f"Sentence {k} " + "w" * 300 + "." for k in range(9))
    parts = chunking.split_text(text)
    assert len(parts) > 1 and all(parts[i + 1].startswith(re.split(r"(?<=[.!?])\s+", parts[i])[-1]) for i in range(len(parts) - 1)) and chunking.split_text("x" * 5000) == ["x" * 5000]
    df = spark.createDataFrame([("d", "c", 0, text, "a"), ("d", "e", 1, "short", "a")], "doc_id string, chunk_id string, ordinal long, text string, section string")
    assert sorted((r.chunk_id, r.piece, r.text) for r in chunking.split_long(df).collect()) == [*(("c", i, t) for i, t in enumerate(parts)), ("e", 0, "short")]
    rows = spark.createDataFrame([("c1", None, "p", None)], "chunk_id string, original_chunk_id string, paper_id string, paper_title string")
    once = chunking.stamp(rows, F.lit("x"), F.lit("T"))
    assert once.first().chunk_id == "p__c1" == chunking.stamp(once, F.lit("x"), F.lit("T")).first().chunk_id and once.first().original_chunk_id == "c1"


PAPER = {"p1": {"title": "T", "abstract": "A", "full_text": [{"section_name": "S", "paragraphs": ["one", "  ", "two"]}], "qas": [
    {"question": "Q1", "question_id": "1", "answers": [{"answer": {"unanswerable": False, "extractive_spans": ["A"], "yes_no": None, "free_form_answer": "", "evidence": ["A", "FLOAT SELECTED x"]}}, {"answer": {"unanswerable": False, "extractive_spans": ["B"], "evidence": ["A", "B"]}}]},
    {"question": "Q2", "question_id": "2", "answers": [{"answer": {"unanswerable": True}}, {"answer": {"unanswerable": False, "yes_no": False, "evidence": ["C"]}}]},
    {"question": "Q3", "question_id": "3", "answers": [{"answer": {"unanswerable": False, "yes_no": True, "evidence": ["FLOAT SELECTED y"]}}]}]}, "p2": {"title": "U"}}


def test_papers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(PAPER))
    df = papers.read_papers(spark, str(tmp_path / "p.json"))
    assert [r.chunk_id for r in chunking.paper_chunks(df).orderBy("ordinal").collect()] == ["p1__s0__p0", "p1__s0__p2"]
    got = {r.qid: r for r in evaluate.answerable_queries(df).collect()}
    assert set(got) == {"p1__1", "p1__2"} and got["p1__1"].evidence == ["A", "B"] and got["p1__1"].reference_answer == "A | B" and got["p1__2"].reference_answer == "no"
    assert [r.paper_id for r in evaluate.papers_with_questions(df).collect()] == ["p1"]
    chunks, listed_ = papers.library_tables(df, min_chars=1)
    papers.write_library(chunks, listed_, str(tmp_path / "lib"))
    assert [(r.paper_id, r.n_chunks) for r in papers.read_library(spark, str(tmp_path / "lib"))[1].collect()] == [("p1", 2)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"metadata": {"title": "x"}, "chunks": [{"chunk_id": "c", "text": "t"}]}))
    (tmp_path / "d" / "bad.json").write_text("{not json")
    assert [r.file for r in papers.read_demo(spark, str(tmp_path / "d" / "*.json")).collect()] == ["a.json"]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>My  title</title></titleStmt><abstract><p>Abs</p></abstract></teiHeader><text><body>
<div><head>Intro</head><p>First.</p><figure type="table"><head>Tab 1</head><table><row><cell role="head">M</cell><cell role="head">F1</cell></row><row><cell>a</cell><cell>1.5</cell></row><row><cell/></row></table></figure><p>Second.</p>
<div><p>Inner.</p></div></div><div><p>{long}</p><figure type="table"><figDesc>only desc</figDesc><table><row><cell>x</cell></row></table></figure></div></body></text></TEI>"""


def test_tei_and_html(spark):
    meta, got = markup.tei_document(TEI.replace("{long}", "z" * 250))
    assert meta == {"title": "My title", "abstract": "Abs"}
    assert [(c["section"], c["chunk_type"], c["text"][:9]) for c in got] == [("Intro", "paragraph", "First. Se"), ("Intro", "table", "Tab 1\n| M"), ("Intro", "paragraph", "Inner."), ("Unknown", "paragraph", "z" * 9), ("Unknown", "table", "only desc")]
    assert got[1]["table_columns"] == ["M", "F1"] and got[1]["table_rows"] == [["a", "1.5"]] and got[1]["index_text"] == "Tab 1 M F1 a 1.5" and got[4]["caption"] == "Table"
    df = spark.createDataFrame([("p", TEI.replace("{long}", "z")), ("q", "<broken")], "paper_id string, tei string")
    rows = markup.parse_tei(df).collect()
    assert sum(r.error is None for r in rows) == 5 and [r.paper_id for r in rows if r.error] == ["q"]
    html = '<body><nav>no</nav><div class="ad">no</div><h1>Head</h1><p>one<p>two &amp; <b>three</b><ul><li>four</ul><script>x</script></body>'
    assert [(c["section"], c["text"]) for c in markup.html_document(html)] == [("Head", "one"), ("Head", "two & three"), ("Head", "four")]


def test_library_of_files(spark, tmp_path):
    """One bad file is one reject; short chunks go; a second build of the same vectors reads the first."""
    tei = TEI.format(long="word " * 60)
    files = spark.createDataFrame([("/in/a.pdf", bytearray(tei.encode())), ("/in/b.c.pdf", bytearray(b"boom")), ("/in/d.pdf", bytearray(b"<broken"))], "path string, content binary")

    def service(raw):
        if raw == b"boom":
            raise TimeoutError("too slow")
        return raw.decode()

    log = papers.build_library(files, service, str(tmp_path / "lib"), min_chars=100)
    chunks, listed_ = papers.read_library(spark, str(tmp_path / "lib"))
    assert (log["n_papers"], log["n_failed"]) == (1, 2) and log["n_chunks"] == chunks.count() > 0 and all(r.chunk_id.startswith("a_") and len(r.text) >= 100 and r.paper_title for r in chunks.collect())
    assert listed_.first().n_chunks == log["n_chunks"]
    rejects = {r.path: r.error for r in spark.read.parquet(str(tmp_path / "lib" / "_rejects")).collect()}
    assert set(rejects) == {"/in/b.c.pdf", "/in/d.pdf"} and rejects["/in/b.c.pdf"] == "TimeoutError: too slow"
    got = [papers.vectors_for(c, str(tmp_path / "vec"), dense.encode) for c in (chunks, chunks, chunks.withColumn("text", F.concat("text", F.lit("x"))))]
    assert [there for _, there in got] == [False, True, False] and got[0][0].count() == chunks.count()


def test_timing_and_tiers(spark):
    rows = [("x", "a", 1, "k1"), ("x", "b", 2, None), ("y", "a", 1, "k1")]
    each = spark.createDataFrame([(s, q, g, k, *[float(i) for i in range(7)]) for s, q, g, k in rows], "strategy string, qid string, gold_count long, query_type string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    kept, ms = evaluate.timed(each, 3)
    assert kept.count() == 3 and ms > 0
    got = {(r.strategy, r.dimension, r.value): r.n for r in evaluate.tiers(each, "query_type").collect()}
    assert got == {("x", "all", "all"): 2, ("y", "all", "all"): 1, ("x", "evidence", "single"): 1, ("x", "evidence", "multi"): 1, ("y", "evidence", "single"): 1, ("x", "query_type", "k1"): 1, ("x", "query_type", "unknown"): 1, ("y", "query_type", "k1"): 1}
    md = runs.tiers_markdown(evaluate.tiers(each, "query_type"))
    assert "## By evidence" in md and "| multi | 1 | 200.0% | - |" in md
    assert retrieve.paper_list(spark.createDataFrame([("b", 2), ("a", 1)], "paper_id string, ordinal long")).first().paper_id == "a"


def test_run_folders(spark, tmp_path):
    run = runs.new_run(str(tmp_path), name="r1")
    with pytest.raises(FileExistsError):
        runs.new_run(str(tmp_path), name="r1")
    runs.write_manifest(run, {"k": 5}, {"n": 1})
    assert json.loads((tmp_path / "latest.json").read_text())["settings"] == {"k": 5}
    each = evaluate.per_query(ranked(spark, [("a", "x", 0, 1, 1.0)]), spark.createDataFrame([("a", "x")], "qid string, chunk_id string")).withColumns({"strategy": F.lit("BM25"), "kind": F.lit(None).cast("string")})
    report = runs.write_report(run, evaluate.summary(each, "strategy"), evaluate.breakdown(each, "kind")).read_text()
    assert "| BM25 | 1 | 100.0%" in report and "| kind | unknown | 1 |" in report


def test_strategies(spark, corpus):
    docs, chunks = corpus
    vecs = dense.encode(chunks, "text").select("chunk_id", "ordinal", "vec")
    q = dense.encode(spark.createDataFrame([("q", "alpha beta"), ("r", "gamma")], "qid string, text string"), "text").withColumnRenamed("vec", "qvec")
    c = retrieve.Corpus(chunks, vecs)
    got = retrieve.run_strategies(c, q, ["BM25", "CE", "Fusion+CE"], 3)
    assert {(r.strategy, r.qid): r["count"] for r in got.groupBy("strategy", "qid").count().collect()} == {(s, x): 3 for s in ("BM25", "CE", "Fusion+CE") for x in "qr"}
    with pytest.raises(ValueError):
        retrieve.run_strategies(c, q, ["nope"])
    scorer = rerank.from_model(lambda pairs: [float(len(b)) for _, b in pairs])
    got = rerank.rerank(bm25.retrieve(chunks, q, 12), q, chunks, 1, scorer).collect()
    assert all(docs[int(r.chunk_id[1:])] == max(docs, key=len) or len(docs[int(r.chunk_id[1:])]) == max(map(len, docs)) for r in got)


def f1(a, b):
    x, y = (set(re.findall("[a-z0-9]+", t.lower())) for t in (a, b))
    return 4.0 * len(x & y) / (len(x) + len(y)) - 1 if x or y else -1.0


def test_searches_equal_brute_force(spark):
    """Search in a paper, with several wordings, and in a library in two stages, against the same steps over lists."""
    r = random.Random(21)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta common word".split()
    docs = [(f"p{i % 6}__c{i}", i, f"p{i % 6}", f"s{i}", " ".join(r.choices(vocabulary, k=r.randint(3, 14)))) for i in range(48)]
    chunks = spark.createDataFrame([(c, o, p, s, "paragraph", None, t) for c, o, p, s, t in docs], "chunk_id string, ordinal long, paper_id string, section string, chunk_type string, caption string, text string")
    texts = [d[4] for d in docs]
    asked = {"x": ["alpha gamma theta", "delta word"], "y": ["zeta zeta common", "beta"]}
    q = dense.encode(spark.createDataFrame([(k, v[0], v) for k, v in asked.items()], "qid string, text string, variants array<string>"), "text").withColumnRenamed("vec", "qvec")
    plans = spark.createDataFrame([(k, "factual", False, False) for k in asked], "qid string, query_type string, cross_table boolean, is_yes_no boolean")
    c = retrieve.Corpus(chunks, dense.encode(chunks, "text").select("chunk_id", "ordinal", "vec"))

    def order(scores):
        return sorted(range(len(docs)), key=lambda i: (-round(scores[i], 9), i))

    def reranked(question, pool, k):
        return [docs[i][0] for i in sorted(pool, key=lambda i: (-round(f1(question, texts[i]), 9), pool.index(i)))[:k]]

    def got(df):
        rows = sorted(df.collect(), key=lambda x: x.rank)
        return {k: [x.chunk_id for x in rows if x.qid == k] for k in asked}

    pools = {k: order(okapi(texts, v[0])) for k, v in asked.items()}
    assert got(retrieve.paper_search(c, q, plans, 5, pool=10)) == {k: reranked(v[0], pools[k][:10], 5) for k, v in asked.items()}
    united = {k: list(dict.fromkeys(i for t in v for i in order(okapi(texts, t))[:40])) for k, v in asked.items()}
    assert got(retrieve.multi_query_search(c, q, plans, 5)) == {k: reranked(v[0], united[k], 5) for k, v in asked.items()}
    papers_ = spark.createDataFrame([(f"p{i}", i, "alpha title" if i == 2 else "a title", " ".join(texts[i::6])[:40]) for i in range(6)], "paper_id string, ordinal long, title string, abstract string")
    chosen = {}
    for x in retrieve.paper_scores(bm25.scores(chunks, q, keep=("paper_id",)), papers_, q, 2).collect():
        chosen.setdefault(x.qid, set()).add(x.paper_id)
    two = got(retrieve.library_search(c, papers_, q, plans, 3, threshold=1))
    for k, v in asked.items():
        inside = [i for i in pools[k] if docs[i][2] in chosen[k]]
        assert reranked(v[0], inside, 1)[0] in two[k] and len(two[k]) == 3


def test_prototype_scores_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    protos = [(lab, r.normal(size=6)) for lab in "aabbbc"]
    asked = [(str(i), r.normal(size=6)) for i in range(20)]
    p = spark.createDataFrame([(lab, v.tolist()) for lab, v in protos], "label string, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked], "qid string, qvec array<double>")
    got = {x.qid: x for x in dense.class_scores(q, p).collect()}
    for i, v in asked:
        sims = {lab: [float(v @ w) for x, w in protos if x == lab] for lab in "abc"}
        score = sorted(((0.75 * max(s) + 0.25 * sum(s) / len(s), lab) for lab, s in sims.items()), reverse=True)
        assert got[i].label == score[0][1] and abs(got[i].score - score[0][0]) < 1e-4 and abs(got[i].margin - (score[0][0] - score[1][0])) < 2e-4


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "s", "q", m % 2 == 0, None if m % 7 == 0 else "wrong") for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, session_id string, question string, helpful boolean, failure_type string").withColumn("ts", F.to_timestamp("ts"))
    feedback.append(df, str(tmp_path / "log"))
    feedback.tail(spark, str(tmp_path / "log"), str(tmp_path / "copy"), str(tmp_path / "ck1"))
    feedback.tail(spark, str(tmp_path / "log"), str(tmp_path / "copy"), str(tmp_path / "ck1"))
    copied = spark.read.parquet(str(tmp_path / "copy"))
    assert copied.count() == len(rows)
    feedback.run(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck2"), late="0 seconds")
    whole = {tuple(r) for r in feedback.windowed(copied).collect()}
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and closed <= whole and sum(r[2] for r in whole) == len(rows)


def test_hashed_search_finds_most(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    vecs = spark.createDataFrame([(str(i), i, x.tolist()) for i, x in enumerate(v)], "chunk_id string, ordinal long, vec array<float>")
    q = vecs.where("ordinal < 20").select(F.col("chunk_id").alias("qid"), F.col("vec").alias("qvec"))
    exact = {(x.qid, x.chunk_id) for x in dense.retrieve(vecs, q, 5).collect()}
    found = {(x.qid, x.chunk_id) for x in dense.retrieve_hashed(vecs, q, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_hashed_search_finds_most_of_64_dimensions(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.normal(size=(8, 64))[r.integers(0, 8, 300)] + 2.5 * r.normal(size=(300, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    vecs = spark.createDataFrame([(str(i), i, x.tolist()) for i, x in enumerate(v)], "chunk_id string, ordinal long, vec array<float>")
    q = vecs.where("ordinal < 20").select(F.col("chunk_id").alias("qid"), F.col("vec").alias("qvec"))
    exact = {(x.qid, x.chunk_id) for x in dense.retrieve(vecs, q, 5).collect()}
    found, one = ({(x.qid, x.chunk_id) for x in dense.retrieve_hashed(vecs, q, 5, flips=n).collect()} for n in (2, 0))
    assert len(exact & found) >= 0.9 * len(exact) > len(exact & one)


def test_entry_without_the_corpus_operators(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def hidden(name, *a, **k):
        if name.startswith("corpus_pipeline"):
            raise ModuleNotFoundError("gone", name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", hidden)
    fresh = importlib.reload(entry)
    assert "bm25_top5" in fresh.queries() and "pipeline" not in fresh.queries() and set(fresh.oracle_sql()) <= set(fresh.queries())
