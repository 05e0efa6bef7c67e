"""Questions to retrieval plans: rules, a semantic override, and a planner's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq import schema
from lumenq.functions import rules as R
from lumenq.functions.text import squeeze, strip

NEEDS = ["method_section", "multi_chunk_synthesis", "single_chunk", "supporting_and_contrary_evidence", "table_or_numeric_sentence", "two_sided_evidence", "two_tables"]
STYLES = ["concise_cited", "explanatory_synthesis", "method_steps", "numeric_with_units", "structured_comparison", "yes_no_then_evidence"]
SOURCES = ["figure_caption", "paragraph", "table"]
STRATEGIES = ["decompose", "fusion", "hyde", "standard"]
OVERRIDE_SCORE, OVERRIDE_MARGIN, SKIP_CONFIDENCE, SKIP_COMPLEXITY = 0.55, 0.15, 0.85, 0.45

_END = r"(?:\s+(?:for|in|on)\s+|\?|$)"
ENTITY_PATTERNS = [
    r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)" + _END,
    r"(?i)\bcompare\s+(.+?)\s+(?:against|and|to|with)\s+(.+?)" + _END,
    r"(?i)\b(.+?)\s+(?:versus|vs\.?)\s+(.+?)" + _END,
    r"(.+?)和(.+?)(?:谁|哪个|的差异|的区别|比较|对比|相比)",
]


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def entities(question: Column) -> Column:
    """The two sides of a comparison, by the first pattern that is found, even if it then yields fewer than two."""
    out = None
    for p in ENTITY_PATTERNS:
        sides = F.array(*[F.regexp_replace(F.regexp_replace(F.regexp_extract(question, p, g), r"(?U)\s+", " "), "^[ ,.;:]+|[ ,.;:]+$", "") for g in (1, 2)])
        sides = F.filter(sides, lambda e: (F.length(e) > 1) & (F.length(e) <= 80))
        out = F.when(question.rlike(p), sides) if out is None else out.when(question.rlike(p), sides)
    return out.otherwise(_strings())


def word_count(question: Column) -> Column:
    return F.size(F.filter(F.split(question, r"(?U)\s+"), lambda w: w != ""))


def rule_fields(question: Column, query_type: Column | None = None) -> dict[str, Column]:
    """The fields of the rules' plan, before the routing metadata."""
    kind = R.classify(question) if query_type is None else query_type
    cross, yes_no, synthesis = R.found(question, R.CROSS_TABLE), R.found(question, R.YES_NO), R.found(question, R.SYNTHESIS)
    cases = [
        (kind == "numerical", "table_or_numeric_sentence", "numeric_with_units", ["must_find_numeric_value", "prefer_table_evidence"]),
        ((kind == "comparison") & cross, "two_tables", "structured_comparison", ["require_two_sided_evidence", "require_two_tables"]),
        (kind == "comparison", "two_sided_evidence", "structured_comparison", ["require_two_sided_evidence"]),
        (yes_no, "supporting_and_contrary_evidence", "yes_no_then_evidence", ["state_yes_no_first", "cite_supporting_evidence"]),
        ((kind == "why_how") | synthesis, "multi_chunk_synthesis", "explanatory_synthesis", ["synthesize_multiple_chunks"]),
        (kind == "methodology", "method_section", "method_steps", ["prefer_method_sections"]),
    ]

    def pick(k: int, last: Column) -> Column:
        out = None
        for case in cases:
            v = _strings(*case[k]) if k == 3 else F.lit(case[k])
            out = F.when(case[0], v) if out is None else out.when(case[0], v)
        return out.otherwise(last)

    figure = R.found(question, R.FIGURE)
    source = F.when(figure, _strings("figure_caption", "paragraph", "table")).when((kind == "numerical") | R.found(question, R.TABLE), _strings("table", "paragraph")).otherwise(_strings("paragraph", "table"))
    return {
        "query_type": kind, "cross_table": cross, "is_yes_no": yes_no, "evidence_need": pick(1, F.lit("single_chunk")), "source_preference": source, "answer_style": pick(2, F.lit("concise_cited")),
        "confidence_checks": F.concat(F.when(figure, _strings("warn_if_figure_missing")).otherwise(_strings()), pick(3, _strings())), "comparison_entities": entities(question),
        "needs_calculation": (kind == "numerical") & R.found(question, R.CALCULATION),
    }


def complexity(question: Column, f: dict[str, Column]) -> Column:
    low = F.lower(question)
    parts = [
        (f["query_type"].isin("why_how", "comparison", "methodology"), 0.35), ((f["query_type"] == "numerical") & f["needs_calculation"], 0.35), (f["evidence_need"] != "single_chunk", 0.25),
        (f["cross_table"], 0.25), (word_count(low) >= 14, 0.15), (R.found(low, R.CONNECTIVE), 0.15),
    ]
    total = F.lit(0.0)
    for test, x in parts:
        total = total + F.when(test, x).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def confidence(question: Column, f: dict[str, Column]) -> Column:
    kind = f["query_type"]
    two = (
        ((kind == "numerical") & (R.found(question, R.TABLE) | R.found(question, R.CALCULATION)))
        | ((kind == "comparison") & R.found(question, R.CROSS_TABLE))
        | ((kind == "why_how") & R.found(question, R.SYNTHESIS))
        | ((kind == "methodology") & R.found(F.lower(question), R.METHOD_SIGNAL))
    )
    signals = F.when(two, 2).when(kind == "factual", 1).otherwise(0) + f["is_yes_no"].cast("int")
    return F.least(F.lit(0.95), 0.55 + 0.15 * signals)


def strategy(f: dict[str, Column]) -> Column:
    return F.when(f["evidence_need"].isin("two_tables", "two_sided_evidence"), "decompose").when(f["query_type"] != "factual", "fusion").otherwise("standard")


def _plan(question: Column, f: dict[str, Column], classifier: str, level: str, sure: Column | None = None) -> Column:
    made = f | {
        "classifier": F.lit(classifier), "route_level": F.lit(level), "route_confidence": confidence(question, f) if sure is None else sure, "complexity_score": complexity(question, f),
        "retrieval_strategy": strategy(f), "rewrite_queries": _strings(), "hyde_query": F.lit(""),
    }
    return F.struct(*[made[c.name].cast(c.dataType).alias(c.name) for c in schema.PLAN])


def route(question: Column) -> Column:
    """The plan that the rules give, with its confidence, complexity and strategy."""
    return _plan(question, rule_fields(question), "small_router", "small_router")


def normalized(f: dict[str, Column], kind: Column) -> dict[str, Column]:
    """The fields made consistent with another query type; a comparison always needs two sides."""
    more = {"numerical": ("table_or_numeric_sentence", "numeric_with_units", ["must_find_numeric_value", "prefer_table_evidence"]), "comparison": ("two_sided_evidence", "structured_comparison", ["require_two_sided_evidence"]),
            "methodology": ("method_section", "method_steps", ["prefer_method_sections"]), "why_how": ("multi_chunk_synthesis", "explanatory_synthesis", ["synthesize_multiple_chunks"])}

    def pick(k: int, last: Column) -> Column:
        out = last
        for name, v in more.items():
            out = F.when(kind == name, F.array_distinct(F.concat(last, _strings(*v[2]))) if k == 2 else F.lit(v[k])).otherwise(out)
        return out

    source = F.when(kind == "numerical", _strings("table", "paragraph")).otherwise(f["source_preference"])
    return f | {"query_type": kind, "evidence_need": pick(0, f["evidence_need"]), "answer_style": pick(1, f["answer_style"]), "confidence_checks": pick(2, f["confidence_checks"]), "source_preference": source}


def overrides(plan_type: Column, label: Column, score: Column, margin: Column) -> Column:
    """Whether a semantic label replaces the rules': only factual ones, when it is clearly apart."""
    return F.coalesce((plan_type == "factual") & (label != "factual") & (score >= OVERRIDE_SCORE) & (margin >= OVERRIDE_MARGIN), F.lit(False))


def route_with_model(question: Column, label: Column, score: Column, margin: Column) -> Column:
    """``route``, or the semantic label's plan where it overrides; null labels never do."""
    base = rule_fields(question)
    other = normalized(base, label)
    sure = F.least(F.lit(0.95), F.greatest(confidence(question, base), score))
    return F.when(overrides(base["query_type"], label, score, margin), _plan(question, other, "regex_plus_local_model", "small_router_model", sure)).otherwise(_plan(question, base, "small_router", "small_router"))


def needs_planner(plan: Column) -> Column:
    """Whether the large planner is worth asking."""
    return ~((plan["route_confidence"] >= SKIP_CONFIDENCE) & (plan["complexity_score"] < SKIP_COMPLEXITY))


_REPLY = T.StructType([T.StructField(n, t) for n, t in [
    ("query_type", T.StringType()), ("cross_table", T.BooleanType()), ("is_yes_no", T.BooleanType()), ("evidence_need", T.StringType()), ("source_preference", T.ArrayType(T.StringType())), ("answer_style", T.StringType()),
    ("confidence_checks", T.ArrayType(T.StringType())), ("comparison_entities", T.ArrayType(T.StringType())), ("needs_calculation", T.BooleanType()), ("retrieval_strategy", T.StringType()),
    ("rewrite_queries", T.ArrayType(T.StringType())), ("hyde_query", T.StringType())]])


def json_object(raw: Column) -> Column:
    """The text from the first brace to the last, whatever stands around it; null without one."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def coerced(question: Column, raw: Column, plan: Column) -> Column:
    """A planner's reply as a plan: values outside the known ones fall back to ``plan``, then the types' rules are enforced. Unreadable replies give ``plan``."""
    text = json_object(raw)
    reply = F.from_json(text, _REPLY, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(text).isNotNull()

    def known(name: str, values: list[str]) -> Column:
        return F.when(reply[name].isin(values), reply[name]).otherwise(plan[name])

    def listed(name: str, values: list[str] | None = None) -> Column:
        x = F.array_distinct(F.filter(F.transform(reply[name], strip), lambda v: v != ""))
        x = x if values is None else F.filter(x, lambda v: v.isin(values))
        return F.coalesce(x, _strings())

    def plus(checks: Column, test: Column, name: str) -> Column:
        return F.when(test & ~F.array_contains(checks, name), F.concat(checks, _strings(name))).otherwise(checks)

    kind = known("query_type", R.TYPES)
    yes_no, cross = F.coalesce(reply["is_yes_no"], plan["is_yes_no"]), F.coalesce(reply["cross_table"], plan["cross_table"])
    own = listed("confidence_checks")
    checks = F.when(F.size(own) > 0, own).otherwise(plan["confidence_checks"])
    checks = plus(checks, yes_no, "state_yes_no_first")
    checks = plus(checks, kind == "numerical", "must_find_numeric_value")
    checks = plus(checks, (kind == "comparison") & cross, "require_two_tables")
    checks = plus(checks, kind == "comparison", "require_two_sided_evidence")
    source = listed("source_preference", SOURCES)
    source = F.when(F.size(source) > 0, source).otherwise(plan["source_preference"])
    source = F.when((kind == "numerical") & ~F.array_contains(source, "table"), F.concat(_strings("table"), source)).otherwise(source)
    sides = listed("comparison_entities")
    sides = F.slice(F.transform(F.when(F.size(sides) > 0, sides).otherwise(plan["comparison_entities"]), lambda e: F.substring(e, 1, 80)), 1, 4)
    need = F.when((kind == "comparison") & cross, "two_tables").when(kind == "comparison", "two_sided_evidence").when(kind == "numerical", "table_or_numeric_sentence").when(yes_no, "supporting_and_contrary_evidence").otherwise(known("evidence_need", NEEDS))
    style = F.when(kind == "comparison", "structured_comparison").when(kind == "numerical", "numeric_with_units").when(yes_no, "yes_no_then_evidence").otherwise(known("answer_style", STYLES))
    f = {"query_type": kind, "cross_table": cross, "is_yes_no": yes_no, "evidence_need": need, "source_preference": source, "answer_style": style, "confidence_checks": checks, "comparison_entities": sides, "needs_calculation": F.coalesce(reply["needs_calculation"], plan["needs_calculation"])}
    made = f | {
        "classifier": F.lit("llm_planner"), "route_level": F.lit("large_planner"), "route_confidence": F.lit(0.9), "complexity_score": complexity(question, f), "retrieval_strategy": known("retrieval_strategy", STRATEGIES),
        "rewrite_queries": F.slice(listed("rewrite_queries"), 1, 4), "hyde_query": F.substring(strip(F.coalesce(reply["hyde_query"], F.lit(""))), 1, 800),
    }
    return F.when(ok, F.struct(*[made[c.name].cast(c.dataType).alias(c.name) for c in schema.PLAN])).otherwise(plan)


def route_table(questions: DataFrame, planner=None, text: str = "question") -> DataFrame:
    """``questions`` with ``plan``. ``planner`` maps a column of questions to raw replies and is asked only where it is worth it."""
    out = questions.withColumn("plan", route(F.col(text)))
    if planner is None:
        return out
    return out.withColumn("plan", F.when(needs_planner(F.col("plan")), coerced(F.col(text), planner(F.col(text)), F.col("plan"))).otherwise(F.col("plan")))


def profile(question: Column, query_type: Column) -> Column:
    """What kinds of evidence a question is after, and the retrieval to begin with."""
    low = F.coalesce(F.lower(question), F.lit(""))
    numeric = (query_type == "numerical") | R.contains_any(low, ["accuracy", "bleu", "experimental result", "f1", "highest", "how many", "how much", "key results", "lower", "higher", "main results", "number", "percent", "performance", "precision", "rate", "recall", "rouge", "score"])
    compared = (query_type == "comparison") | R.contains_any(low, [" vs ", "compare", "difference", "different", "versus", "which method"])
    synthesis = (query_type == "why_how") | R.contains_any(low, R.SYNTHESIS_PHRASES)
    method = query_type.isin("why_how", "methodology") | R.contains_any(low, ["approach", "architecture", "how do", "method", "why"])
    start = F.when(numeric, "retrieve_numeric_or_table").when(compared | method | synthesis, "retrieve_fusion").otherwise("retrieve_evidence")
    return F.struct(numeric.alias("numeric_or_table"), compared.alias("comparison"), (method | synthesis).alias("method_or_explanation"), synthesis.alias("synthesis_or_contribution"), start.alias("suggested_start"))


def proxy_label(question: Column) -> Column:
    """A label from the question's wording alone, by patterns independent of the router's."""
    return R.classify(question, R.BENCH_RULES)


TEMPLATES: dict[str, list[str]] = {
    "numerical": ["How many {s} are reported?", "What is the accuracy of {s}?", "What BLEU score do {s} reach?", "What is the batch size for {s}?", "How much does recall change with {s}?"],
    "comparison": ["Compare {s} with earlier systems.", "What is the difference between {s} and rules?", "Do {s} outperform retrieval?", "Are {s} better than a plain model?", "Strengths and weaknesses of {s}?"],
    "methodology": ["Which encoder do {s} use?", "Describe the loss function of {s}.", "What masking strategy suits {s}?", "List the implementation details of {s}.", "Which beam search do {s} need?"],
    "why_how": ["Why do {s} matter?", "Summarize the part on {s}.", "Explain {s} in plain terms.", "State the main finding on {s}.", "What is the motivation for {s}?"],
    "factual": ["Who collected {s}?", "Which language do {s} cover?", "Where were {s} published?", "When did {s} appear?", "Name the license of {s}."],
}
SUBJECTS = [f"{a} {b}" for a in ("graph", "speech", "vision", "dialogue", "legal") for b in ("parsers", "taggers", "corpora", "readers")]


def synthetic_questions(spark) -> DataFrame:
    """500 labelled questions: five templates of each of five labels over twenty subjects."""
    temps = spark.createDataFrame([(label, k, t) for label, ts in TEMPLATES.items() for k, t in enumerate(ts)], "label string, template_no int, template string")
    subjects = spark.createDataFrame([(k, s) for k, s in enumerate(SUBJECTS)], "subject_no int, subject string")
    full = temps.crossJoin(F.broadcast(subjects))  # twenty rows
    return full.select("label", F.concat_ws("-", "label", F.col("template_no").cast("string"), F.col("subject_no").cast("string")).alias("qid"), F.replace("template", F.lit("{s}"), F.col("subject")).alias("question"))


def confusion(labelled: DataFrame, expected: str = "label", predicted: str = "pred") -> DataFrame:
    """One row for each expected label with a count for each predicted one, and the accuracy."""
    out = labelled.groupBy(expected).pivot(predicted, R.TYPES).agg(F.count(F.lit(1)))
    out = out.select(F.col(expected).alias("label"), *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in R.TYPES])
    total = sum((F.col(t) for t in R.TYPES[1:]), F.col(R.TYPES[0]))
    right = F.coalesce(*[F.when(F.col("label") == t, F.col(t)) for t in R.TYPES], F.lit(0))
    return out.withColumn("n", total).withColumn("accuracy", F.round(right / total, 6))


def threshold_sweep(predicted: DataFrame, scores: list[float], margins: list[float]) -> DataFrame:
    """Accuracy and overrides of every pair of thresholds over (label, rule, model, score, margin), best first."""
    spark = predicted.sparkSession
    grid = spark.createDataFrame([(float(s), float(m)) for s in scores for m in margins], "min_score double, min_margin double")
    full = predicted.crossJoin(F.broadcast(grid))  # a grid of a few dozen rows
    over = (F.col("rule") == "factual") & (F.col("model") != "factual") & (F.col("score") >= F.col("min_score")) & (F.col("margin") >= F.col("min_margin"))
    out = full.withColumn("over", over).withColumn("pred", F.when(over, F.col("model")).otherwise(F.col("rule")))
    return out.groupBy("min_score", "min_margin").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"), F.sum(F.col("over").cast("long")).alias("overrides"), F.count("*").alias("n"))


def squeezed(question: Column) -> Column:
    return squeeze(question)
