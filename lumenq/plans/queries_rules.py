"""Queries over routing, rewriting, numbers, verification, metrics, judging and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenq import schema
from lumenq.functions import rules as R
from lumenq.functions import text as X
from lumenq.operators import agent, bm25, evaluate, judge, numeric, postprocess, prompt, rerank, retrieve, rewrite, router, verify
from lumenq.plans import frames, sql
from lumenq.plans import queries_text as texts
from lumenq.plans.registry import query
from lumenq.sources import markup
from lumenq.streaming import feedback

_SYNTH = "synth AS (SELECT label, label || '-' || k || '-' || n AS qid, replace(t, '{s}', s) AS question FROM " + sql.literal([(label, k, t) for label, ts in router.TEMPLATES.items() for k, t in enumerate(ts)]) + " AS a(label, k, t), " + sql.literal(list(enumerate(router.SUBJECTS))) + " AS b(n, s))"
_ASKED = r"asked AS (SELECT label, qid, question FROM synth UNION ALL SELECT NULL, 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '[^\x00-\x7f]'))"


def _m(pattern: str, c: str = "question") -> str:
    return f"regexp_matches({c}, '{pattern}')"


@query("route_bench_rules", sql.cte(_SYNTH, _ASKED) + f"SELECT qid, {sql.rules_case(R.BENCH_RULES)} AS query_type FROM asked")
def route_bench_rules(spark, d):
    return frames.asked(spark, d).select("qid", R.classify(F.col("question"), R.BENCH_RULES).alias("query_type"))


@query("route_app_rules", sql.cte(_SYNTH, _ASKED) + f"SELECT qid, {sql.rules_case(R.APP_RULES)} AS query_type, {_m(R.YES_NO)} AS is_yes_no, {_m(R.CROSS_TABLE_APP)} AS cross_table, CASE {sql.rules_case(R.APP_RULES)} WHEN 'numerical' THEN 'hint.numerical' WHEN 'why_how' THEN 'hint.why_how' END AS hint FROM asked")
def route_app_rules(spark, d):
    q = F.col("question")
    return frames.asked(spark, d).select("qid", R.classify(q).alias("query_type"), R.found(q, R.YES_NO).alias("is_yes_no"), R.found(q, R.CROSS_TABLE_APP).alias("cross_table"), R.hint(R.classify(q)).alias("hint"))


_RULES = f"r AS (SELECT *, {sql.rules_case(R.APP_RULES)} AS kind, {_m(R.CROSS_TABLE)} AS cross_table, {_m(R.YES_NO)} AS yes_no, {_m(R.SYNTHESIS)} AS syn, {_m(R.FIGURE)} AS fig, {_m(R.TABLE)} AS tab, {_m(R.CALCULATION)} AS calc FROM asked)"
_CASES = ["WHEN kind = 'numerical' THEN {0}", "WHEN kind = 'comparison' AND cross_table THEN {1}", "WHEN kind = 'comparison' THEN {2}", "WHEN yes_no THEN {3}", "WHEN kind = 'why_how' OR syn THEN {4}", "WHEN kind = 'methodology' THEN {5}", "ELSE {6}"]


def _case(*values: str) -> str:
    return "CASE " + " ".join(_CASES).format(*values) + " END"


_NEED = _case("'table_or_numeric_sentence'", "'two_tables'", "'two_sided_evidence'", "'supporting_and_contrary_evidence'", "'multi_chunk_synthesis'", "'method_section'", "'single_chunk'")
_STYLE = _case("'numeric_with_units'", "'structured_comparison'", "'structured_comparison'", "'yes_no_then_evidence'", "'explanatory_synthesis'", "'method_steps'", "'concise_cited'")
_CHECKS = _case("['must_find_numeric_value', 'prefer_table_evidence']", "['require_two_sided_evidence', 'require_two_tables']", "['require_two_sided_evidence']", "['state_yes_no_first', 'cite_supporting_evidence']", "['synthesize_multiple_chunks']", "['prefer_method_sections']", "[]")
_PLAN = f"""p AS (SELECT *, {_NEED} AS need, {_STYLE} AS style, list_concat(CASE WHEN fig THEN ['warn_if_figure_missing'] ELSE [] END, {_CHECKS}) AS checks, kind = 'numerical' AND calc AS needs_calculation,
 CASE WHEN fig THEN 'figure_caption,paragraph,table' WHEN kind = 'numerical' OR tab THEN 'table,paragraph' ELSE 'paragraph,table' END AS source_preference FROM r)"""


@query("route_plan", sql.cte(_SYNTH, _ASKED, _RULES, _PLAN) + "SELECT qid, kind AS query_type, cross_table, yes_no AS is_yes_no, need AS evidence_need, style AS answer_style, array_to_string(checks, ',') AS confidence_checks, needs_calculation, source_preference, CASE WHEN need IN ('two_tables', 'two_sided_evidence') THEN 'decompose' WHEN kind <> 'factual' THEN 'fusion' ELSE 'standard' END AS retrieval_strategy FROM p")
def route_plan(spark, d):
    p = F.col("plan")
    names = ["query_type", "cross_table", "is_yes_no", "evidence_need", "answer_style", "needs_calculation", "retrieval_strategy"]
    return router.route_table(frames.asked(spark, d)).select("qid", *[p[n].alias(n) for n in names], F.array_join(p["confidence_checks"], ",").alias("confidence_checks"), F.array_join(p["source_preference"], ",").alias("source_preference"))


_COMPLEX = f"""least(1.0, (kind IN ('why_how', 'comparison', 'methodology'))::INT * 0.35 + (kind = 'numerical' AND calc)::INT * 0.35 + (need <> 'single_chunk')::INT * 0.25 + cross_table::INT * 0.25
 + (len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) >= 14)::INT * 0.15 + {_m(R.CONNECTIVE, "lower(question)")}::INT * 0.15)"""
_SIGNALS = f"""CASE WHEN (kind = 'numerical' AND (tab OR calc)) OR (kind = 'comparison' AND cross_table) OR (kind = 'why_how' AND syn) OR (kind = 'methodology' AND {_m(R.METHOD_SIGNAL, "lower(question)")}) THEN 2 WHEN kind = 'factual' THEN 1 ELSE 0 END + yes_no::INT"""


@query("route_complexity", sql.cte(_SYNTH, _ASKED, _RULES, _PLAN) + f"SELECT qid, round(({_COMPLEX})::DOUBLE, 6) AS complexity, round(least(0.95, 0.55 + 0.15 * ({_SIGNALS}))::DOUBLE, 6) AS confidence FROM p")
def route_complexity(spark, d):
    return router.route_table(frames.asked(spark, d)).select("qid", F.round("plan.complexity_score", 6).alias("complexity"), F.round("plan.route_confidence", 6).alias("confidence"))


def _tail(kind: str) -> str:
    return "[question, " + ", ".join((f"question || ' ' || '{t}'" if added else f"'{t}'") for added, t in rewrite.TAILS[kind] if "{" not in t) + "]"


_WIDE = " OR ".join(f"contains(lower(question), '{p}')" for p in R.SYNTHESIS_PHRASES)


@query(
    "query_variants",
    sql.cte(_SYNTH, _ASKED, _RULES, f"v AS (SELECT qid, CASE WHEN kind = 'numerical' THEN {_tail('numerical')} WHEN kind = 'why_how' OR {_WIDE} THEN {_tail('why_how')} WHEN kind = 'methodology' THEN {_tail('methodology')} ELSE [question] END AS vs FROM r WHERE kind <> 'comparison')")
    + "SELECT qid, CAST(i AS BIGINT) AS variant, vs[i] AS text FROM v, unnest(range(1, len(vs) + 1)) AS u(i)",
)
def query_variants(spark, d):
    rows = router.route_table(frames.asked(spark, d)).where("plan.query_type <> 'comparison'")
    out = rows.select("qid", F.posexplode(rewrite.of_plan(F.col("question"), F.col("plan"))).alias("variant", "text"))
    return out.select("qid", (F.col("variant") + 1).cast("long").alias("variant"), "text")


def _side(pattern: str, group: int) -> str:
    return f"regexp_replace(regexp_replace(regexp_extract(question, '{pattern}', {group}), '\\s+', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


_SIDES = "CASE " + " ".join(f"WHEN {_m(p)} THEN [{_side(p, 1)}, {_side(p, 2)}]" for p in router.ENTITY_PATTERNS) + " ELSE [] END"
_ENTITIES = f"ent AS (SELECT *, list_filter({_SIDES}, lambda e: length(e) > 1 AND length(e) <= 80) AS sides FROM p)"


@query("comparison_entities", sql.cte(_SYNTH, _ASKED, _RULES, _PLAN, _ENTITIES) + "SELECT qid, array_to_string(sides, ' | ') AS entities FROM ent")
def comparison_entities(spark, d):
    return router.route_table(frames.asked(spark, d)).select("qid", F.array_join("plan.comparison_entities", " | ").alias("entities"))


@query("effective_k", sql.cte(_SYNTH, _ASKED, _RULES) + "SELECT qid, CASE WHEN yes_no THEN 8 WHEN kind = 'why_how' THEN 7 ELSE 5 END AS k5, CASE WHEN yes_no THEN 8 WHEN kind = 'why_how' THEN 7 ELSE 6 END AS k6 FROM r")
def effective_k(spark, d):
    p = F.col("plan")
    return router.route_table(frames.asked(spark, d)).select("qid", *[postprocess.effective_k(p["query_type"], p["is_yes_no"], k).alias(f"k{k}") for k in (5, 6)])


_NORM = "lambda x, i: list_position(list_transform(parts, lambda y: lower(trim(regexp_replace(y, '\\s+', ' ', 'g')))), lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) = i AND trim(x) <> ''"
_COMPARED = "[question || ' ' || array_to_string(sides, ' ') || '" + rewrite.TAILS["comparison"][0][1][len("{entities}") :] + "', question || ' " + rewrite.TAILS["comparison"][1][1] + "']"


@query(
    "decomposed_queries",
    sql.cte(
        _SYNTH, _ASKED, _RULES, _PLAN, _ENTITIES,
        "cut AS (SELECT *, list_filter(list_transform(regexp_split_to_array(question, '(?i)\\b(?: (?:and|compared to|compared with|difference between|or|versus|vs\\.?) )\\b'), lambda x: trim(regexp_replace(x, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'))), lambda x: length(x) BETWEEN 3 AND 120) AS pieces FROM ent)",
        f"more AS (SELECT qid, list_concat(list_concat(sides[1:4], pieces), CASE WHEN kind = 'numerical' THEN [question || ' exact number', question || ' table'] WHEN kind = 'comparison' THEN {_COMPARED} WHEN kind = 'why_how' OR (kind = 'methodology' AND ({_WIDE})) THEN {_tail('why_how')}[2:4] WHEN kind = 'methodology' THEN {_tail('methodology')}[2:4] ELSE [] END) AS parts FROM cut)",
        f"seen AS (SELECT qid, list_filter(parts, {_NORM})[1:6] AS ps FROM more)",
    )
    + "SELECT qid, CAST(i - 1 AS INTEGER) AS part, ps[i] AS text FROM seen, unnest(range(1, len(ps) + 1)) AS u(i)",
)
def decomposed_queries(spark, d):
    rows = router.route_table(frames.asked(spark, d))
    return rows.select("qid", F.posexplode(rewrite.decomposed(F.col("question"), F.col("plan"))).alias("part", "text"))


@query("router_confusion_500", sql.cte(_SYNTH, f"c AS (SELECT label, {sql.rules_case(R.APP_RULES)} AS pred FROM synth)") + "SELECT label, " + ", ".join(f"count(*) FILTER (pred = '{t}') AS {t}" for t in R.TYPES) + ", count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM c GROUP BY label")
def router_confusion_500(spark, d):
    return router.confusion(router.synthetic_questions(spark).withColumn("pred", R.classify(F.col("question"))))


_SCORES, _MARGINS = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7], [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


@query(
    "threshold_sweep",
    sql.cte(_SYNTH, f"s AS (SELECT label, {sql.rules_case(R.BENCH_RULES)} AS rule, {sql.rules_case(R.APP_RULES)} AS model, (length(question) * 37 % 100)::DOUBLE / 100 AS score, (length(question) * 11 % 40)::DOUBLE / 100 AS margin FROM synth)",
            "g AS (SELECT a.x::DOUBLE AS min_score, b.y::DOUBLE AS min_margin FROM " + sql.literal([(x,) for x in _SCORES]) + " AS a(x), " + sql.literal([(y,) for y in _MARGINS]) + " AS b(y))",
            "o AS (SELECT *, rule = 'factual' AND model <> 'factual' AND score >= min_score AND margin >= min_margin AS ov FROM s, g)")
    + "SELECT min_score, min_margin, round(avg(((CASE WHEN ov THEN model ELSE rule END) = label)::INT), 6) AS accuracy, count(*) FILTER (ov) AS overrides, count(*) AS n FROM o GROUP BY min_score, min_margin",
)
def threshold_sweep(spark, d):
    q, n = F.col("question"), F.length("question")
    rows = router.synthetic_questions(spark).select("label", R.classify(q, R.BENCH_RULES).alias("rule"), R.classify(q).alias("model"), ((n * 37 % 100).cast("double") / 100).alias("score"), ((n * 11 % 40).cast("double") / 100).alias("margin"))
    return router.threshold_sweep(rows, _SCORES, _MARGINS)


_FACTS = r"""rows AS (SELECT 'n' || c_nationkey AS qid, 't' || c_nationkey AS chunk_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_no, c_name, CAST(c_acctbal AS VARCHAR) AS b FROM customer),
cells AS (SELECT qid, chunk_id, row_no, 0 AS col, c_name AS cell, 'customer' AS metric, c_name AS row_label FROM rows UNION ALL SELECT qid, chunk_id, row_no, 1, b, 'balance', c_name FROM rows),
raw AS (SELECT *, unnest(regexp_extract_all(cell, '-?\d+(?:,\d{3})*(?:\.\d+)?%?')) AS raw_value FROM cells),
facts AS (SELECT qid, chunk_id, CAST(raw_value AS DOUBLE) AS value, raw_value, metric, row_label, row_number() OVER (PARTITION BY qid ORDER BY row_no, col) AS seq FROM raw)"""


@query("numeric_facts_table", sql.cte(_FACTS) + "SELECT qid, chunk_id, seq, value, raw_value, metric, row_label FROM facts")
def numeric_facts_table(spark, d):
    return numeric.table_facts(frames.balance_tables(spark, d)).select("qid", "chunk_id", F.col("seq").cast("long").alias("seq"), "value", "raw_value", "metric", "row_label")


@query(
    "numeric_candidates",
    sql.cte(_FACTS, "f AS (SELECT * FROM facts WHERE metric = 'balance')")
    + "SELECT qid, count(*) AS n, arg_max(raw_value, {'v': value, 'o': -seq}) AS max_raw, arg_min(raw_value, {'v': value, 'o': seq}) AS min_raw, round(avg(value), 6) AS mean, CASE WHEN count(*) >= 2 THEN round(max(value) - min(value), 6) END AS difference FROM f GROUP BY qid",
)
def numeric_candidates(spark, d):
    ranked = frames.balance_tables(spark, d)
    asked = ranked.select("qid", F.lit("Give the highest and the lowest balance, the mean and the gap").alias("question"))
    # every fact's caption holds "balances", so only the column named balance matches the question's term
    chosen = numeric.relevant(numeric.table_facts(ranked), asked)
    return numeric.candidates(chosen).select("qid", "n", "max_raw", "min_raw", "mean", "difference")


@query(
    "numeric_notes",
    sql.cte(_FACTS, "a AS (SELECT qid, count(*) AS total FROM facts GROUP BY qid)", "m AS (SELECT qid, chunk_id, count(*) AS n, arg_max(raw_value, {'v': value, 'o': -seq}) AS raw, arg_max(row_label, {'v': value, 'o': -seq}) AS who, string_agg('[1] ' || row_label || ' / balance = ' || raw_value, '; ' ORDER BY seq) AS vs FROM facts WHERE metric = 'balance' GROUP BY qid, chunk_id)")
    + "SELECT qid, total || ' numeric values in the sources; ' || n || ' match the question best.' || chr(10) || 'Candidate maximum: ' || raw || ' at ' || who || ' / balance' || CASE WHEN n <= 8 THEN chr(10) || 'Values: ' || vs ELSE '' END AS notes FROM a JOIN m USING (qid)",
)
def numeric_notes(spark, d):
    ranked = frames.balance_tables(spark, d)
    asked = ranked.select("qid", F.lit("What is the highest balance?").alias("question"), F.lit("numerical").alias("query_type"), F.lit(True).alias("needs_calculation"))
    return numeric.notes(ranked, asked)


@query("numeric_facts_text")
def numeric_facts_text(spark, d):
    ranked = frames.doc_chunks(spark, d).select(F.lit("all").alias("qid"), "chunk_id", F.lit(1).alias("rank"), "text", "caption", "section")
    return numeric.text_facts(ranked).drop("qid", "row_label")


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _content(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z][a-z0-9_-]{{2,}}')), lambda w: w NOT IN ({_STOPS}))"


_CLAIMS = r"""parts AS (SELECT qid, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\[[0-9,\s]+\]', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), ';\s+|\n+', chr(1), 'g'), chr(1)) AS ps FROM queries),
trimmed AS (SELECT qid, list_filter(list_transform(ps, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' -')), lambda p: length(p) >= 12)[1:12] AS cs FROM parts),
claims AS (SELECT qid, CAST(i - 1 AS INTEGER) AS claim_no, cs[i] AS claim FROM trimmed, unnest(range(1, len(cs) + 1)) AS u(i))"""
_EVIDENCE = [sql.DOCS, sql.ITEMS, sql.bm25("s", "chunks", "queries"), sql.completed("f", "s", "chunks", "queries", 3), sql.top("t", "f", 3)]


_SUPPORT = [
    *_EVIDENCE, _CLAIMS, f"c AS (SELECT *, {_content('claim')} AS ws, regexp_extract_all(claim, '-?\\d+(?:\\.\\d+)?%?') AS ns FROM claims)",
    f"e AS (SELECT t.qid, t.chunk_id, rank, lower(text) AS low, {_content('text')} AS hs FROM t JOIN chunks USING (chunk_id))",
    "x AS (SELECT c.qid, claim_no, claim, len(ns) AS nn, chunk_id, rank, len(list_intersect(ws, hs)) AS overlap, greatest(len(ws), 1) AS nw, CASE WHEN len(ns) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ns, lambda n: contains(low, lower(n))))::DOUBLE / len(ns) END AS k FROM c JOIN e USING (qid))",
    "y AS (SELECT *, 0.75 * (overlap::DOUBLE / nw) + 0.25 * k AS sc FROM x)",
    "b AS (SELECT *, round(sc, 9) > CASE WHEN nn = 0 THEN 0.25 ELSE 0 END AS taken FROM (SELECT *, row_number() OVER (PARTITION BY qid, claim_no ORDER BY round(sc, 9) DESC, rank) AS n FROM y) WHERE n = 1)",
    "z AS (SELECT qid, claim_no, claim, nn, CASE WHEN taken THEN chunk_id ELSE '' END AS best_chunk_id, CASE WHEN taken THEN overlap ELSE 0 END AS overlap, CASE WHEN taken THEN round(overlap::DOUBLE / nw, 3) ELSE 0 END AS token_support, CASE WHEN taken THEN round(k, 3) WHEN nn = 0 THEN 1 ELSE 0 END AS number_support FROM b)",
    "sup AS (SELECT qid, CAST(claim_no AS BIGINT) AS claim_no, claim, best_chunk_id, token_support::DOUBLE AS token_support, number_support >= 1 AND (token_support >= 0.35 OR (nn = 0 AND overlap >= 3)) AS supported FROM z)",
]


def _joined(ranked, docs, *columns):
    """A list with columns of its chunks."""
    return ranked.join(rerank.listed(docs, ranked).select(*columns), "chunk_id")


@query("claim_support", sql.cte(*_SUPPORT) + "SELECT qid, claim_no, best_chunk_id, token_support, supported FROM sup")
def claim_support(spark, d):
    q = frames.items(spark, d)
    docs = frames.doc_chunks(spark, d)
    proof = _joined(bm25.retrieve(docs, q, 3), docs, "chunk_id", "text")
    out = verify.claim_support(verify.claim_table(q.select("qid", F.col("text").alias("answer"))), proof)
    return out.select("qid", F.col("claim_no").cast("long").alias("claim_no"), "best_chunk_id", F.col("token_support").cast("double").alias("token_support"), "supported")


@query(
    "answer_support",
    sql.cte(*_SUPPORT)
    + r"SELECT qid, count(*) AS n_claims, count(*) FILTER (supported) AS n_supported, round(avg(supported::INT), 3) AS coverage, coalesce(string_agg(regexp_replace(claim, '\.+$', '') || '.', ' ' ORDER BY claim_no) FILTER (supported), '') AS supported_answer, bool_and(supported) AS verified FROM sup GROUP BY qid",
)
def answer_support(spark, d):
    q = frames.items(spark, d)
    docs = frames.doc_chunks(spark, d)
    proof = _joined(bm25.retrieve(docs, q, 3), docs, "chunk_id", "text")
    return verify.answer_support(verify.claim_support(verify.claim_table(q.select("qid", F.col("text").alias("answer"))), proof))


_KINDS = "CASE item_id % 3 WHEN 0 THEN 'numerical' WHEN 1 THEN 'comparison' ELSE 'factual' END"


def _kinds(spark, d):
    n = F.col("item_id") % 3
    return frames.items(spark, d).withColumn("query_type", F.when(n == 0, "numerical").when(n == 1, "comparison").otherwise("factual"))


@query(
    "context_inspection",
    sql.cte(
        *_EVIDENCE, f"k AS (SELECT CAST(item_id AS VARCHAR) AS qid, {_KINDS} AS kind FROM benchmark)",
        "a AS (SELECT t.qid, count(*) AS n_evidence, count(DISTINCT source) AS n_sections, count(*) FILTER (contains(text, '|')) AS n_tables, count(*) FILTER (regexp_matches(text, '(?:^|[^A-Za-z])-?[0-9]')) AS n_numeric FROM t JOIN chunks USING (chunk_id) GROUP BY t.qid)",
        "g AS (SELECT qid, n_evidence, n_sections, n_tables, n_numeric, kind = 'numerical' AND n_numeric = 0 AND n_tables = 0 AS g1, kind = 'comparison' AND n_sections < 2 AS g2 FROM k JOIN a USING (qid))",
    )
    + "SELECT qid, n_evidence, n_sections, n_tables, n_numeric, NOT g1 AND NOT g2 AS sufficient, CASE WHEN g1 THEN 'numeric/table evidence missing' WHEN g2 THEN 'multi-source evidence may be insufficient' ELSE '' END AS gaps FROM g",
)
def context_inspection(spark, d):
    q, docs = _kinds(spark, d), frames.doc_chunks(spark, d)
    proof = _joined(bm25.retrieve(docs, q, 3), docs, "chunk_id", "text", "section", "chunk_type")
    return verify.inspect(proof, q)


_QRELS = "qrels AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


@query("qrels_exact", sql.cte(_QRELS) + "SELECT qid, chunk_id FROM qrels")
def qrels_exact(spark, d):
    return evaluate.exact_qrels(frames.items(spark, d), frames.doc_chunks(spark, d))


_TOP5 = [sql.DOCS, sql.ITEMS, sql.bm25("s", "chunks", "queries"), sql.completed("f", "s", "chunks", "queries", 10), sql.top("t", "f", 10), _QRELS]
_EACH = """gold AS (SELECT qid, count(*) AS gold_count FROM qrels GROUP BY qid),
hits AS (SELECT t.qid, t.chunk_id, rank, q.chunk_id IS NOT NULL AS g FROM t LEFT JOIN qrels q ON q.qid = t.qid AND q.chunk_id = t.chunk_id),
agg AS (SELECT qid, max((g AND rank <= 1)::INT)::DOUBLE AS hit1, max((g AND rank <= 3)::INT)::DOUBLE AS hit3, max((g AND rank <= 5)::INT)::DOUBLE AS hit5, sum(CASE WHEN g AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum((g AND rank <= 5)::INT) AS found, min(CASE WHEN g THEN rank END) AS first_gold_rank FROM hits GROUP BY qid),
each AS (SELECT gold.qid, gold_count, hit1, hit3, hit5, dcg / list_sum(list_transform(range(1, least(gold_count, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg5, found::DOUBLE / gold_count AS evidence_recall5, (found = gold_count)::INT::DOUBLE AS all_evidence_recall5, coalesce(1.0::DOUBLE / first_gold_rank, 0) AS mrr, first_gold_rank FROM gold JOIN agg USING (qid))"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)


def _each(spark, d, chunks=None, **kw):
    docs = frames.doc_chunks(spark, d) if chunks is None else chunks
    q = frames.items(spark, d)
    ranked = bm25.retrieve(docs, q, 10)
    if kw:
        ranked = _joined(ranked, docs, "chunk_id", "section")
    return evaluate.per_query(ranked, evaluate.exact_qrels(q, frames.doc_chunks(spark, d)), **kw)


@query("retrieval_metrics", sql.cte(*_TOP5, _EACH) + f"SELECT count(*) AS n, {_MEANS}, round(avg(first_gold_rank), 6) AS mean_gold_rank, round(median(first_gold_rank), 6) AS median_gold_rank FROM each")
def retrieval_metrics(spark, d):
    return evaluate.summary(_each(spark, d))


@query(
    "metrics_breakdown",
    sql.cte(*_TOP5, _EACH, "l AS (SELECT each.*, CASE WHEN gold_count = 1 THEN 'single' ELSE 'multi' END AS evidence, CAST(CAST(qid AS BIGINT) % 3 AS VARCHAR) AS third FROM each)")
    + f"SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, {_MEANS} FROM l UNION ALL SELECT 'evidence', evidence, count(*), {_MEANS} FROM l GROUP BY evidence UNION ALL SELECT 'third', third, count(*), {_MEANS} FROM l GROUP BY third",
)
def metrics_breakdown(spark, d):
    each = _each(spark, d).withColumns({"evidence": evaluate.evidence_group(F.col("gold_count")), "third": (F.col("qid").cast("long") % 3).cast("string")})
    return evaluate.breakdown(each, "evidence", "third")


@query("random_lift", sql.cte(*_TOP5, _EACH, "p AS (SELECT ndcg5, least(gold_count, 5) AS g, gold_count, (SELECT count(*) FROM documents) AS n FROM each)", "q AS (SELECT ndcg5, gold_count::DOUBLE / n * list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) / list_sum(list_transform(range(1, g + 1), lambda i: 1 / log2(i + 1))) AS r FROM p)") + "SELECT count(*) AS n, round(avg(ndcg5), 6) AS ndcg5, round(avg(r), 6) AS random_ndcg5, round(avg(ndcg5) / avg(r), 4) AS lift FROM q")
def random_lift(spark, d):
    docs = frames.doc_chunks(spark, d)
    return evaluate.random_lift(_each(spark, d), frames.items(spark, d).select("qid").crossJoin(docs.agg(F.count("*").alias("n_chunks"))))


@query("strategy_tiers", sql.cte(*_TOP5, _EACH, "l AS (SELECT each.*, CASE WHEN gold_count = 1 THEN 'single' ELSE 'multi' END AS evidence, CASE CAST(qid AS BIGINT) % 3 WHEN 0 THEN 'numerical' WHEN 1 THEN 'comparison' ELSE 'factual' END AS query_type FROM each)", f"u AS (SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, {_MEANS} FROM l UNION ALL SELECT 'evidence', evidence, count(*), {_MEANS} FROM l GROUP BY evidence UNION ALL SELECT 'query_type', query_type, count(*), {_MEANS} FROM l GROUP BY query_type)") + "SELECT s.strategy, u.* FROM u, (VALUES ('first'), ('second')) AS s(strategy)")
def strategy_tiers(spark, d):
    """One list under two names."""
    each = _each(spark, d).join(_kinds(spark, d).select("qid", "query_type"), "qid").withColumn("strategy", F.explode(F.array(F.lit("first"), F.lit("second"))))
    return evaluate.tiers(each, "query_type")


@query("gold_rank_median", sql.cte(*_TOP5, _EACH) + "SELECT CASE WHEN gold_count = 1 THEN 'single' ELSE 'multi' END AS evidence, count(*) AS n, round(median(first_gold_rank), 6) AS median_gold_rank, round(avg(first_gold_rank), 6) AS mean_gold_rank FROM each GROUP BY 1")
def gold_rank_median(spark, d):
    each = _each(spark, d).withColumn("evidence", evaluate.evidence_group(F.col("gold_count")))
    return evaluate.summary(each, "evidence").select("evidence", "n", "median_gold_rank", "mean_gold_rank")


@query("section_redundancy", sql.cte(*_TOP5, _EACH) + "SELECT t.qid, round(1 - count(DISTINCT source)::DOUBLE / count(*), 6) AS section_redundancy FROM t JOIN chunks USING (chunk_id) WHERE rank <= 5 AND t.qid IN (SELECT qid FROM gold) GROUP BY t.qid")
def section_redundancy(spark, d):
    return _each(spark, d, section="section").select("qid", F.round("section_redundancy", 6).alias("section_redundancy"))


@query("stratified_sample", "SELECT doc_id, quality, sample_no FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS sample_no FROM labels) WHERE sample_no <= 10")
def stratified_sample(spark, d):
    return evaluate.stratified(frames.table(spark, d, "labels"), "quality", key="doc_id").select("doc_id", "quality", "sample_no")


_CASES_SQL = "cases AS (SELECT CAST(doc_id AS VARCHAR) AS qid, CASE WHEN toxic = 1 THEN 'INSUFFICIENT' WHEN quality = 1 THEN 'FULLY_SUFFICIENT' ELSE 'PARTIALLY_SUFFICIENT' END AS verdict, doc_id % 5 + 1 AS score, (doc_id % 2)::DOUBLE AS hit5, (1.0::DOUBLE / (doc_id % 7 + 1)) AS mrr FROM labels)"


@query("badcase_pool", sql.cte(_CASES_SQL) + "SELECT qid, verdict, score FROM cases WHERE verdict = 'INSUFFICIENT' UNION ALL SELECT qid, verdict, score FROM (SELECT * FROM cases WHERE verdict = 'PARTIALLY_SUFFICIENT' ORDER BY score, hit5, mrr, qid LIMIT 20)")
def badcase_pool(spark, d):
    t = frames.table(spark, d, "labels")
    verdict = F.when(F.col("toxic") == 1, "INSUFFICIENT").when(F.col("quality") == 1, "FULLY_SUFFICIENT").otherwise("PARTIALLY_SUFFICIENT")
    rows = t.select(F.col("doc_id").cast("string").alias("qid"), verdict.alias("verdict"), (F.col("doc_id") % 5 + 1).alias("score"), (F.col("doc_id") % 2).cast("double").alias("hit5"), (1.0 / (F.col("doc_id") % 7 + 1)).alias("mrr"))
    return judge.badcase_pool(rows).select("qid", "verdict", "score")


_REPLIES = ['```json\n{"score": 5, "verdict": "FULLY_SUFFICIENT", "missing_facts": [], "reason": "all there"}\n```', 'Sure: {"score": 3} done', "no object here", '{"score": 9, "verdict": "GREAT"}', '{"score": "x", "missing_facts": ["a", "b"]}', '{"score": 2, "missing_facts": "one fact"}', '{"score": 0}', '{"score": 4, "reason": "fine"', '{"verdict": "PARTIALLY_SUFFICIENT", "score": 1}']
_JUDGE = r"""raw AS (SELECT d.doc_id, r.reply FROM documents d JOIN """ + sql.literal(list(enumerate(_REPLIES))) + r""" AS r(k, reply) ON r.k = d.doc_id % 9),
j AS (SELECT doc_id, CASE WHEN json_valid(o) THEN o END AS o FROM (SELECT doc_id, nullif(regexp_extract(reply, '(?s)(\{.*\})', 1), '') AS o FROM raw)),
s AS (SELECT doc_id, o, CAST(greatest(1, least(5, coalesce(trunc(try_cast(json_extract_string(o, '$.score') AS DOUBLE)), 1))) AS INTEGER) AS score, json_extract_string(o, '$.verdict') AS v, CASE WHEN json_type(o, '$.missing_facts') = 'ARRAY' THEN json_array_length(o, '$.missing_facts') WHEN json_extract_string(o, '$.missing_facts') IS NOT NULL THEN 1 ELSE 0 END AS m FROM j)"""


@query("judge_coercion", sql.cte(_JUDGE) + "SELECT doc_id, score, CASE WHEN o IS NULL THEN 'INSUFFICIENT' WHEN v IN ('FULLY_SUFFICIENT', 'PARTIALLY_SUFFICIENT', 'INSUFFICIENT') THEN v WHEN score >= 4 THEN 'FULLY_SUFFICIENT' WHEN score = 3 THEN 'PARTIALLY_SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict, CAST(CASE WHEN o IS NULL THEN 1 ELSE least(m, 5) END AS BIGINT) AS n_missing FROM s")
def judge_coercion(spark, d):
    reply = F.element_at(F.array(*[F.lit(r) for r in _REPLIES]), (F.col("doc_id") % 9 + 1).cast("int"))
    j = judge.judgement(F.col("reply"))
    rows = frames.table(spark, d, "documents").select("doc_id", reply.alias("reply")).select("doc_id", j.alias("j"))
    return rows.select("doc_id", "j.score", "j.verdict", F.size("j.missing_facts").cast("long").alias("n_missing"))


@query(
    "judged_results",
    sql.cte(
        sql.DOCS, sql.ITEMS, sql.bm25("s", "chunks", "queries"), sql.completed("f", "s", "chunks", "queries", 5), sql.top("t", "f", 5),
        "ctx AS (SELECT t.qid, string_agg('[Chunk ' || CAST(rank AS VARCHAR) || ' | ' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN chunks USING (chunk_id) GROUP BY t.qid)",
        f"w AS (SELECT qid, {_content('queries.text')} AS want, {_content("coalesce(context, '')")} AS have FROM queries LEFT JOIN ctx USING (qid))",
        "v AS (SELECT qid, CAST(least(5, 1 + floor(len(list_intersect(want, have))::DOUBLE / greatest(len(want), 1) * 4)) AS INTEGER) AS score FROM w)",
    )
    + "SELECT qid, CASE WHEN score >= 4 THEN 'FULLY_SUFFICIENT' WHEN score = 3 THEN 'PARTIALLY_SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict, score FROM v",
)
def judged_results(spark, d):
    q, docs = frames.items(spark, d), frames.doc_chunks(spark, d)
    ranked = _joined(bm25.retrieve(docs, q, 5), docs, "chunk_id", "text")
    from lumenq.operators.chunking import context_block

    results = q.select("qid", F.col("text").alias("question"), F.col("text").alias("reference_answer")).join(context_block(ranked), "qid", "left")
    first, _ = judge.two_pass(results.withColumns({"hit5": F.lit(0.0), "mrr": F.lit(0.0)}))
    return first.select("qid", "verdict", "score")


@query(
    "random_baseline",
    "SELECT source, count(*) AS n_chunks, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_gold, round(ceil(count(*) / 20.0) / count(*) * list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) / list_sum(list_transform(range(1, CAST(least(ceil(count(*) / 20.0), 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg5 FROM documents GROUP BY source",
)
def random_baseline(spark, d):
    per = frames.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_chunks")).withColumn("n_gold", F.ceil(F.col("n_chunks") / 20).cast("long"))
    return per.withColumn("ndcg5", F.round(evaluate.random_ndcg(F.col("n_chunks"), F.col("n_gold")), 6))


@query(
    "expanded_corpus_metrics",
    "SELECT * FROM (" + sql.cte(_TOP5[0].replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 0)"), *_TOP5[1:], _EACH) + f"SELECT 'dev' AS corpus, count(*) AS n, {_MEANS} FROM each) UNION ALL SELECT * FROM (" + sql.cte(*_TOP5, _EACH) + f"SELECT 'expanded', count(*), {_MEANS} FROM each)",
)
def expanded_corpus_metrics(spark, d):
    docs = frames.doc_chunks(spark, d)
    out = None
    for name, chunks in (("dev", docs.where(F.col("doc_id") % 2 == 0)), ("expanded", docs)):
        rows = evaluate.summary(_each(spark, d, chunks).withColumn("corpus", F.lit(name)), "corpus").select("corpus", "n", *evaluate.METRICS)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("feedback_by_type", "SELECT date_trunc('hour', ts) AS window_start, coalesce(event_type, 'unknown') AS failure_type, count(*) AS n, count(*) FILTER (value >= 10) AS n_helpful FROM events GROUP BY 1, 2")
def feedback_by_type(spark, d):
    e = frames.table(spark, d, "events").select("ts", F.col("event_type").alias("failure_type"), (F.col("value") >= 10).alias("helpful"))
    return feedback.windowed(e)


@query("parse_pages")
def parse_pages(spark, d):
    return markup.parse_html(frames.table(spark, d, "pages")).select("page_id", "chunk_id", "section", F.length("text").alias("n_chars"))


_COERCED = """c AS (SELECT *, kind AS rule, cross_table AS cr, CASE WHEN label IN ('numerical', 'comparison', 'methodology', 'why_how', 'factual') THEN label ELSE kind END AS k FROM ent),
n AS (SELECT *, CASE WHEN k = 'comparison' AND cr THEN 'two_tables' WHEN k = 'comparison' THEN 'two_sided_evidence' WHEN k = 'numerical' THEN 'table_or_numeric_sentence' ELSE need END AS nd,
 CASE WHEN k = 'numerical' AND NOT list_contains(checks, 'must_find_numeric_value') THEN list_concat(checks, ['must_find_numeric_value']) ELSE checks END AS c1, string_split(source_preference, ',') AS sp FROM c),
o AS (SELECT *, CASE WHEN k = 'comparison' AND cr AND NOT list_contains(c1, 'require_two_tables') THEN list_concat(c1, ['require_two_tables']) ELSE c1 END AS c2 FROM n)"""
_ADDED = f"0.0::DOUBLE + CASE WHEN k IN ('why_how', 'comparison', 'methodology') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN k = 'numerical' AND needs_calculation THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN nd <> 'single_chunk' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN cr THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) >= 14 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {_m(R.CONNECTIVE, 'lower(question)')} THEN 0.15::DOUBLE ELSE 0 END"


@query(
    "planner_coercion",
    sql.cte(_SYNTH, _ASKED, _RULES, _PLAN, _ENTITIES, _COERCED)
    + f"""SELECT qid, k AS query_type, cr AS cross_table, FALSE AS is_yes_no, nd AS evidence_need, CASE WHEN k = 'numerical' AND NOT list_contains(sp, 'table') THEN list_concat(['table'], sp) ELSE sp END AS source_preference,
 CASE WHEN k = 'comparison' THEN 'structured_comparison' WHEN k = 'numerical' THEN 'numeric_with_units' ELSE style END AS answer_style,
 CASE WHEN k = 'comparison' AND NOT list_contains(c2, 'require_two_sided_evidence') THEN list_concat(c2, ['require_two_sided_evidence']) ELSE c2 END AS confidence_checks, sides[1:4] AS comparison_entities, needs_calculation, 'llm_planner' AS classifier,
 'large_planner' AS route_level, 0.9::DOUBLE AS route_confidence, least(1.0::DOUBLE, {_ADDED}) AS complexity_score, CASE WHEN need IN ('two_tables', 'two_sided_evidence') THEN 'decompose' WHEN rule <> 'factual' THEN 'fusion' ELSE 'standard' END AS retrieval_strategy, ['a', 'b'] AS rewrite_queries, '' AS hyde_query FROM o""",
)
def planner_coercion(spark, d):
    reply = F.concat(F.lit('Plan: {"query_type": "'), F.coalesce("label", F.lit("nonsense")), F.lit('", "rewrite_queries": ["a", "b", "a"], "is_yes_no": false}'))
    rows = router.route_table(frames.asked(spark, d)).withColumn("plan", router.coerced(F.col("question"), reply, F.col("plan")))
    return rows.select("qid", *[F.col("plan")[f.name].alias(f.name) for f in schema.PLAN])


@query("prototype_labels")
def prototype_labels(spark, d):
    """The synthetic questions by their similarity to the first template of each label, with the offline encoder."""
    from lumenq.operators import dense

    q = dense.encode(router.synthetic_questions(spark), "question")
    protos = q.where("qid rlike '-0-[0-3]$'").select("label", "vec")
    return dense.class_scores(q.select("qid", F.col("vec").alias("qvec")), protos)


@query("agent_trace")
def agent_trace(spark, d):
    """The offline policy over all lines of the documents."""
    lines = frames.lines(spark, d).withColumn("chunk_type", F.when(F.col("text").contains("|"), "table").otherwise("paragraph"))
    q = _kinds(spark, d).select("qid", F.col("text").alias("question"), "query_type")
    asked = q.select("*", router.profile(F.col("question"), F.col("query_type")).alias("profile"), F.array(F.substring("question", 1, 60)).alias("rewrites"))
    return agent.run_indexed(lines, asked).drop("rounds")


@query("agent_metrics", sql.cte(*_TOP5, _EACH) + f"SELECT 'BM25 list' AS name, count(*) AS n, {_MEANS}, round(avg(CAST(qid AS BIGINT) * 1.5), 6) AS latency_ms FROM each")
def agent_metrics(spark, d):
    """Agent runs that retrieved what BM25 ranks first; their latency is made up."""
    q, docs = frames.items(spark, d), frames.doc_chunks(spark, d)
    ids = bm25.retrieve(docs, q, 10).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    runs = q.join(ids, "qid").select("qid", F.concat(F.array(F.lit(None).cast("string"), F.lit("")), "ids").alias("retrieved_ids"), (F.col("item_id") * 1.5).alias("latency_ms"))
    return evaluate.agent_summary(evaluate.agent_results(runs, evaluate.exact_qrels(q, docs)), "BM25 list")


_PROMPT = [
    *_EVIDENCE, "k AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS question, item_id % 3 AS m FROM benchmark)",
    "b AS (SELECT t.qid, rank, score, source, CASE WHEN contains(text, '|') THEN '[' || rank || '] (Paper: ' || coalesce(lang, 'current paper') || '; Table: ' || coalesce(source, 'Table') ELSE '[' || rank || '] (Paper: ' || coalesce(lang, 'current paper') || '; Section: ' || coalesce(source, '') END || ')' || chr(10) || coalesce(text, '') AS block, lang FROM t JOIN chunks USING (chunk_id))",
    "e AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS sources, count(DISTINCT lang) AS papers, bool_and(score < 0) AS neg, max(CASE WHEN rank = 1 THEN score END) AS top FROM b GROUP BY qid)",
    f"q AS (SELECT qid, sources, 'top score ' || format('{{:.2f}}', top) || chr(10) || 'all scores negative: ' || neg || chr(10) || 'low confidence: false' || CASE WHEN papers > 0 THEN chr(10) || 'papers: ' || papers ELSE '' END || CASE WHEN neg THEN chr(10) || '{prompt.WEAK}' ELSE '' END || CASE WHEN papers > 1 THEN chr(10) || '{prompt.SEVERAL.replace(chr(39), chr(39) * 2)}' ELSE '' END AS quality FROM e)",
]
_HEADS = "chr(10) || chr(10) || "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_STYLES = ["numeric_with_units", "structured_comparison", "concise_cited"]
_PROMPT_SQL = (
    "'Question: ' || question || " + _HEADS + "'Policy:' || chr(10) || CASE m WHEN 0 THEN " + _quoted(prompt.POLICIES[_STYLES[0]]) + " WHEN 1 THEN " + _quoted(prompt.POLICIES[_STYLES[1]]) + " ELSE " + _quoted(prompt.POLICIES[_STYLES[2]]) + " END || " + _HEADS
    + "'Checks:' || chr(10) || '- must find numeric value' || chr(10) || CASE WHEN m = 1 THEN '- compare these, where supported: left, right' || chr(10) ELSE '' END || '- evidence need: single_chunk' || chr(10) || '- preferred sources: table, paragraph' || " + _HEADS
    + "'Numbers:' || chr(10) || 'None.' || " + _HEADS + "'Evidence:' || chr(10) || coalesce(quality, " + _quoted(prompt.NO_SOURCES) + ") || " + _HEADS + "'Sources:' || chr(10) || coalesce(sources, '') || " + _HEADS
    + "'Requirements:' || chr(10) || " + _quoted("\n".join(f"- {x}" for x in prompt.REQUIREMENTS)) + " || " + _HEADS + "'Answer:'"
)


@query("answer_prompt", sql.cte(*_PROMPT) + f"SELECT k.qid, {_quoted(prompt.SYSTEM)} AS system, {_PROMPT_SQL} AS prompt FROM k LEFT JOIN q USING (qid)")
def answer_prompt(spark, d):
    """Prompts over the three best documents, whose language stands in for the paper."""
    docs = frames.doc_chunks(spark, d)
    ranked = _joined(bm25.retrieve(docs, frames.items(spark, d), 3), docs, "chunk_id", "section", "chunk_type", "text", "caption", F.col("lang").alias("paper_id"))
    m, none = F.col("item_id") % 3, F.array().cast("array<string>")
    style = F.when(m == 0, _STYLES[0]).when(m == 1, _STYLES[1]).otherwise(_STYLES[2])
    plan = F.struct(style.alias("answer_style"), F.array(F.lit("must_find_numeric_value")).alias("confidence_checks"), F.when(m == 1, F.array(F.lit("left"), F.lit("right"))).otherwise(none).alias("comparison_entities"), F.lit("single_chunk").alias("evidence_need"), F.array(F.lit("table"), F.lit("paragraph")).alias("source_preference"))
    return prompt.prompts(frames.items(spark, d).select("qid", F.col("text").alias("question"), plan.alias("plan")), ranked)


@query("library_stats", "SELECT count(*) AS n_chunks, count(*) FILTER (contains(text, '|')) AS n_tables, (SELECT count(DISTINCT source) FROM documents) AS n_papers, round(count(*)::DOUBLE / (SELECT count(DISTINCT source) FROM documents), 6) AS chunks_per_paper FROM documents")
def library_stats(spark, d):
    docs = frames.doc_chunks(spark, d)
    return retrieve.library_stats(docs, docs.select("source").distinct())


@query("retrieval_quality", sql.cte(*_EVIDENCE) + "SELECT t.qid, round(max(CASE WHEN rank = 1 THEN score END), 6) AS top_score, bool_and(score < 0) AS all_negative, count(DISTINCT source) AS n_papers FROM t JOIN chunks USING (chunk_id) GROUP BY t.qid")
def retrieval_quality(spark, d):
    docs = frames.doc_chunks(spark, d)
    ranked = _joined(bm25.retrieve(docs, frames.items(spark, d), 3), docs, "chunk_id", "source")
    return verify.quality(ranked, "source").withColumn("top_score", F.round("top_score", 6))


_VIEWS = [
    "asked AS (SELECT NULL AS label, qid, text AS question FROM queries)", _RULES, _PLAN, _ENTITIES,
    f"views AS (SELECT qid, CASE WHEN kind = 'numerical' THEN {_tail('numerical')} WHEN kind = 'comparison' THEN list_concat([question], {_COMPARED}) WHEN kind = 'why_how' OR {_WIDE} THEN {_tail('why_how')} WHEN kind = 'methodology' THEN {_tail('methodology')} ELSE [question] END AS parts FROM ent)",
    f"kept AS (SELECT qid, list_filter(parts, {_NORM}) AS ps FROM views)", "vs AS (SELECT qid || '#' || CAST(i - 1 AS VARCHAR) AS qid, qid AS q, i - 1 AS v, ps[i] AS text FROM kept, unnest(range(1, len(ps) + 1)) AS u(i))",
]


@query(
    "all_strategies",
    sql.cte(
        *texts._both(100), texts._rrf_sql("rf", 1, 1, 100), "bp AS (SELECT * FROM bl WHERE rank <= 50)", "rp AS (SELECT * FROM rf WHERE rank <= 50)", texts._pairs_sql("ce", "bp"), texts._pairs_sql("rce", "rp"),
        *_VIEWS, sql.bm25("vb", "chunks", "vs"), sql.completed("vf", "vb", "chunks", "vs", 100), sql.top("vbl", "vf", 100), "vd AS (SELECT vs.qid, ds.chunk_id, ds.ordinal, ds.score FROM vs JOIN ds ON ds.qid = vs.q)", sql.top("vdl", "vd", 100), texts._rrf_sql("vr", 1, 1, 100, "vbl", "vdl"),
        "m AS (SELECT vs.q AS qid, chunk_id, min(ordinal) AS ordinal, sum((CASE WHEN v = 0 THEN 1.0 ELSE 0.7 END)::DOUBLE / (60 + rank)) AS score, min({'v': v, 'r': rank}) AS first FROM vr JOIN vs ON vs.qid = vr.qid GROUP BY vs.q, chunk_id)",
        "mp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, ordinal) AS rank FROM m) WHERE rank <= 50)", texts._pairs_sql("fce", "mp"),
    )
    + texts._lists_sql(**{"BM25": "bl", "Dense": "dl", "RRF": "rf", "CE": "ce", "RRF+CE": "rce", "Fusion+CE": "fce"}),
)
def all_strategies(spark, d):
    return texts._ranked(retrieve.run_strategies(texts._corpus(spark, d), frames.items_with_vectors(spark, d)), "strategy")
