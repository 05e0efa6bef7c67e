"""Checking answers against evidence, and whether evidence suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import PLAIN_NUMBER, content_tokens, numbers, squeeze
from lumenq.operators.postprocess import has_number, is_table

MOST_CLAIMS, LEAST_CHARS = 12, 12
TOKEN_SUPPORT, OVERLAP, TOKEN_WEIGHT, NUMBER_WEIGHT = 0.35, 3, 0.75, 0.25


def claims(answer: Column) -> Column:
    """Sentences, clauses and lines of an answer, citations taken out; those of 12 characters or more, 12 at most."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[[0-9,\s]+\]", "")
    parts = F.transform(F.split(bare, r"(?<=[.!?])\s+|;\s+|\n+"), lambda p: F.regexp_replace(squeeze(p), "^[ -]+|[ -]+$", ""))
    return F.slice(F.filter(parts, lambda p: F.length(p) >= LEAST_CHARS), 1, MOST_CLAIMS)


def claim_table(answers: DataFrame) -> DataFrame:
    """(qid, claim_no, claim) of answers (qid, answer)."""
    return answers.select("qid", F.posexplode(claims(F.col("answer"))).alias("claim_no", "claim"))


def claim_support(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each claim its best evidence of the same question (qid, chunk_id, rank, text), and whether that supports it.

    The first of equals is best; evidence that adds nothing over none isn't taken.
    """
    words = claimed.withColumn("words", content_tokens(F.col("claim"))).withColumn("nums", numbers(F.col("claim"), PLAIN_NUMBER))
    texts = evidence.select("qid", "chunk_id", "rank", F.lower("text").alias("low"), content_tokens(F.col("text")).alias("held"))
    pairs = words.join(texts, "qid", "left")
    overlap = F.coalesce(F.size(F.array_intersect("words", "held")), F.lit(0))
    share = F.round(overlap / F.greatest(F.size("words"), F.lit(1)), 3)
    there = F.size(F.filter("nums", lambda n: F.coalesce(F.col("low").contains(F.lower(n)), F.lit(False))))
    number_share = F.when(F.size("nums") == 0, 1.0).otherwise(F.round(there / F.size("nums"), 3))
    scored = pairs.withColumns({"overlap": overlap, "token_support": share, "number_support": number_share, "exact": F.when(F.col("rank").isNotNull(), TOKEN_WEIGHT * overlap / F.greatest(F.size("words"), F.lit(1)) + NUMBER_WEIGHT * F.when(F.size("nums") == 0, 1.0).otherwise(there / F.size("nums")))})
    floor = F.when(F.size("nums") == 0, NUMBER_WEIGHT).otherwise(0.0)
    w = Window.partitionBy("qid", "claim_no").orderBy(F.round("exact", 9).desc_nulls_last(), "rank")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    taken = F.coalesce(F.round("exact", 9) > floor, F.lit(False))
    out = best.select(
        "qid", "claim_no", "claim", F.when(taken, F.col("chunk_id")).otherwise("").alias("best_chunk_id"), F.when(taken, F.col("overlap")).otherwise(0).alias("overlap"),
        F.when(taken, F.col("token_support")).otherwise(0.0).alias("token_support"), F.when(taken, F.col("number_support")).otherwise(F.when(F.size("nums") == 0, 1.0).otherwise(0.0)).alias("number_support"), (F.size("nums") > 0).alias("has_numbers"),
    )
    supported = (F.col("number_support") >= 1.0) & ((F.col("token_support") >= TOKEN_SUPPORT) | (~F.col("has_numbers") & (F.col("overlap") >= OVERLAP)))
    return out.withColumn("supported", supported)


def answer_support(checked: DataFrame) -> DataFrame:
    """For each question the share of supported claims, the text of those, and whether all are."""
    sentence = F.concat(F.regexp_replace("claim", r"\.+$", ""), F.lit("."))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("claim_no", sentence.alias("s"))))), lambda x: x["s"]), " ")
    return checked.groupBy("qid").agg(
        F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"), F.round(F.avg(F.col("supported").cast("int")), 3).alias("coverage"), kept.alias("supported_answer"), F.min("supported").alias("verified")
    )


def inspect(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether each question's (qid, query_type) evidence suffices, with its gaps and counts."""
    facts = evidence.groupBy("qid").agg(
        F.count("*").alias("n_evidence"), F.count_distinct(F.when(F.col("section") != "", F.col("section"))).alias("n_sections"), F.count_if(is_table(F.col("chunk_type"))).alias("n_tables"), F.count_if(has_number(F.col("text"))).alias("n_numeric")
    )
    counts = ["n_evidence", "n_sections", "n_tables", "n_numeric"]
    full = queries.select("qid", "query_type").join(facts, "qid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    none = F.col("n_evidence") == 0
    no_numbers = (F.col("query_type") == "numerical") & (F.col("n_numeric") == 0) & (F.col("n_tables") == 0)
    narrow = F.col("query_type").isin("comparison", "why_how", "methodology") & (F.col("n_sections") < 2)
    gaps = F.concat_ws("; ", F.when(none, "no evidence retrieved"), F.when(no_numbers, "numeric/table evidence missing"), F.when(narrow, "multi-source evidence may be insufficient"))
    return full.select("qid", *counts, (~none & ~no_numbers & ~narrow).alias("sufficient"), gaps.alias("gaps"))


def quality(ranked: DataFrame, paper: str = "doc_id") -> DataFrame:
    """Top score, whether all scores are below 0, and how many papers a question's evidence spans."""
    return ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.bool_and(F.col("score") < 0).alias("all_negative"), F.count_distinct(paper).alias("n_papers"))
