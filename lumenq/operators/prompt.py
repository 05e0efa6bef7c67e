"""The prompt that an answer is generated from: policy, checks, notes on numbers and evidence, and numbered sources.

All of it is built-in string expressions, one row for each question, so that a generator may be mapped over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTS_EACH = 12
SYSTEM = "You answer questions about research papers from numbered sources only. Cite them as [1], [2]. Read a table's header before comparing its cells. Say so where the sources don't suffice."
POLICIES = {
    "numeric_with_units": "Give the exact figure with its unit or metric, and the arithmetic if something is computed; reported results come before settings.",
    "structured_comparison": "Treat both sides with evidence for each; say if one side isn't covered, and rank only what was measured on the same benchmark.",
    "yes_no_then_evidence": "Begin with Yes, No or Not enough information; the cited evidence follows.",
    "explanatory_synthesis": "Combine the sources into one explanation of causes or reasons, tied to what the paper does.",
    "method_steps": "List components or steps in order, each with its role and what it passes on.",
    "concise_cited": "Answer directly, with as much detail as the question needs, cited.",
}
REQUIREMENTS = ["The first sentence answers.", "Evidence or mechanism comes next.", "Background isn't the paper's own contribution.", "Every claim of weight has a citation.", "What is missing is named."]
NO_SOURCES = "No sources were found; say that there isn't enough information."
WEAK = "The evidence is weak; call the answer partly supported."
SEVERAL = "The sources are of different papers; don't present them as one controlled comparison."


def policy(style: Column) -> Column:
    """The policy's text for an answer style; an unknown or null one is concise."""
    out = F.lit(POLICIES["concise_cited"])
    for name, text in POLICIES.items():
        out = F.when(style == name, text).otherwise(out)
    return out


def checks(confidence_checks: Column, entities: Column, need: Column, sources: Column) -> Column:
    """The plan's checks as lines, then its entities, if any, its need and its preferred sources."""
    empty = F.array().cast("array<string>")
    lines = F.transform(F.coalesce(confidence_checks, empty), lambda c: F.concat(F.lit("- "), F.replace(c, F.lit("_"), F.lit(" "))))
    sides = F.when(F.size(F.coalesce(entities, empty)) > 0, F.array(F.concat(F.lit("- compare these, where supported: "), F.array_join(entities, ", ")))).otherwise(empty)
    rest = F.array(F.concat(F.lit("- evidence need: "), F.coalesce(need, F.lit("single_chunk"))), F.concat(F.lit("- preferred sources: "), F.array_join(F.coalesce(sources, empty), ", ")))
    return F.array_join(F.concat(lines, sides, rest), "\n")


def source_block(number: Column, chunk_type: Column, paper: Column, section: Column, caption: Column, text: Column) -> Column:
    """One source, by its kind: several tables, one table, or a paragraph."""
    head, of = F.concat(F.lit("["), number.cast("string"), F.lit("] (")), F.concat(F.lit("Paper: "), F.coalesce(paper, F.lit("current paper")))
    joint = F.concat(head, F.lit("Tables side by side: "), F.coalesce(caption, F.lit("Tables")))
    one = F.concat(head, of, F.lit("; Table: "), F.coalesce(caption, section, F.lit("Table")))
    plain = F.concat(head, of, F.lit("; Section: "), F.coalesce(section, F.lit("")))
    return F.concat(F.when(chunk_type == "merged_tables", joint).when(chunk_type == "table", one).otherwise(plain), F.lit(")\n"), F.coalesce(text, F.lit("")))


def facts_by_chunk(facts: DataFrame, most: int = FACTS_EACH) -> DataFrame:
    """The first ``most`` facts of each chunk of a question."""
    w = Window.partitionBy("qid", "chunk_id").orderBy("source_rank", "seq")
    return facts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def evidence_quality(ranked: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(qid, quality): the best score, whether all are below 0, the flag of low confidence and how many papers there are, with what follows from it.

    ``ranked`` has qid, rank, score and ``paper``, and may have low_confidence.
    """
    low = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("low_confidence"))), F.lit(False)) if "low_confidence" in ranked.columns else F.lit(False)
    per = ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.bool_and(F.coalesce("score", F.lit(0.0)) < 0).alias("negative"), low.alias("low"), F.count_distinct(F.when(F.col(paper) != "", F.col(paper))).alias("papers"))
    notes = F.concat_ws(
        "\n", F.concat(F.lit("top score "), F.format_string("%.2f", F.coalesce("top", F.lit(0.0)))), F.concat(F.lit("all scores negative: "), F.col("negative").cast("string")), F.concat(F.lit("low confidence: "), F.col("low").cast("string")),
        F.when(F.col("papers") > 0, F.concat(F.lit("papers: "), F.col("papers").cast("string"))), F.when(F.col("low") | F.col("negative"), WEAK), F.when(F.col("papers") > 1, SEVERAL),
    )
    return per.select("qid", notes.alias("quality"))


def prompts(questions: DataFrame, ranked: DataFrame, notes: DataFrame | None = None, paper: str = "paper_id") -> DataFrame:
    """(qid, system, prompt) of each question (qid, question, plan); ``ranked`` is its evidence, ``notes`` (qid, notes) what was computed from its numbers."""
    block = source_block(F.col("rank"), F.col("chunk_type"), F.col(paper), F.col("section"), F.col("caption"), F.col("text"))
    sources = ranked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("sources"))
    full = questions.select("qid", "question", "plan").join(sources, "qid", "left").join(evidence_quality(ranked, paper), "qid", "left")
    full = full.join(notes.select("qid", "notes"), "qid", "left") if notes is not None else full.withColumn("notes", F.lit(None).cast("string"))
    plan = F.col("plan")
    own = F.when(plan.isNull(), "- use only the cited sources").otherwise(checks(plan["confidence_checks"], plan["comparison_entities"], plan["evidence_need"], plan["source_preference"]))
    parts = [
        ("Question: ", F.col("question")), ("Policy:\n", policy(plan["answer_style"])), ("Checks:\n", own), ("Numbers:\n", F.coalesce("notes", F.lit("None."))),
        ("Evidence:\n", F.coalesce("quality", F.lit(NO_SOURCES))), ("Sources:\n", F.coalesce("sources", F.lit(""))), ("Requirements:\n", F.lit("\n".join(f"- {x}" for x in REQUIREMENTS))), ("Answer:", F.lit("")),
    ]
    return full.select("qid", F.lit(SYSTEM).alias("system"), F.array_join(F.array(*[F.concat(F.lit(head), F.coalesce(x, F.lit(""))) for head, x in parts]), "\n\n").alias("prompt"))
