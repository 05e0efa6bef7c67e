"""Judging retrieved evidence: readings of a judge's reply, the pool of bad cases, and the two passes.

A judge maps a column of prompts to a column of raw replies. The offline default
scores by how many of the reference answer's words the evidence holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import content_tokens
from lumenq.operators.evaluate import PARTIAL_POOL
from lumenq.operators.router import json_object

Judge = Callable[[Column, Column, Column], Column]
VERDICTS = ["FULLY_SUFFICIENT", "INSUFFICIENT", "PARTIALLY_SUFFICIENT"]
CATEGORIES = ["MISSING_EVIDENCE", "REDUNDANCY", "RETRIEVAL_FAILURE"]


def verdict_of(score: Column) -> Column:
    return F.when(score >= 4, "FULLY_SUFFICIENT").when(score == 3, "PARTIALLY_SUFFICIENT").otherwise("INSUFFICIENT")


def judgement(raw: Column) -> Column:
    """A reply as struct(score, verdict, missing_facts, reason); whatever can't be read is a score of 1 and insufficient."""
    text = json_object(raw)
    ok = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    text = F.when(ok, text)
    number = F.get_json_object(text, "$.score").try_cast("double")
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(number, F.lit(1.0)).cast("int")))
    said = F.get_json_object(text, "$.verdict")
    verdict = F.when(~ok, "INSUFFICIENT").when(said.isin(VERDICTS), said).otherwise(verdict_of(score))
    missing = F.get_json_object(text, "$.missing_facts")
    empty = F.array().cast("array<string>")
    items = F.when(missing.startswith("["), F.from_json(missing, "array<string>")).when(F.coalesce(missing, F.lit("")) != "", F.array(missing)).otherwise(empty)
    facts = F.when(~ok, F.array(F.lit("judge_parse_error"))).otherwise(F.transform(F.slice(F.coalesce(items, empty), 1, 5), lambda x: F.substring(x, 1, 160)))
    reason = F.when(ok, F.substring(F.coalesce(F.get_json_object(text, "$.reason"), F.lit("")), 1, 500)).otherwise("Judge response could not be parsed")
    return F.struct(score.alias("score"), verdict.alias("verdict"), facts.alias("missing_facts"), reason.alias("reason"))


def category(raw: Column) -> Column:
    said = F.get_json_object(json_object(raw), "$.category")
    return F.when(said.isin(CATEGORIES), said).otherwise("RETRIEVAL_FAILURE")


def fixable(kind: Column) -> Column:
    return kind.isin("REDUNDANCY", "RETRIEVAL_FAILURE")


def lexical_judge(question: Column, reference: Column, context: Column) -> Column:
    """Offline reply: a score of 1 to 5 by the share of the reference's content words in the context."""
    want = content_tokens(F.coalesce(reference, question))
    share = F.size(F.array_intersect(want, content_tokens(F.coalesce(context, F.lit(""))))) / F.greatest(F.size(want), F.lit(1))
    return F.concat(F.lit('{"score": '), (1 + F.floor(share * 4)).cast("string"), F.lit(', "reason": "word overlap"}'))


def judged(results: DataFrame, judge: Judge = lexical_judge) -> DataFrame:
    """Results (qid, question, reference_answer, context) with ``judgement``."""
    return results.withColumn("judgement", judgement(judge(F.col("question"), F.col("reference_answer"), F.col("context"))))


def badcase_pool(rows: DataFrame, most: int = PARTIAL_POOL) -> DataFrame:
    """All insufficient cases (qid, verdict, score, hit5, mrr) and the ``most`` worst partial ones."""
    partial = rows.where("verdict = 'PARTIALLY_SUFFICIENT'").orderBy("score", "hit5", "mrr", "qid").limit(most)
    return rows.where("verdict = 'INSUFFICIENT'").unionByName(partial)


def two_pass(results: DataFrame, judge: Judge = lexical_judge, second: Judge | None = None, most: int = PARTIAL_POOL) -> tuple[DataFrame, DataFrame]:
    """All judged results, and the bad cases with a category and whether that can be fixed."""
    first = judged(results, judge).withColumns({"verdict": F.col("judgement.verdict"), "score": F.col("judgement.score")})
    pool = badcase_pool(first, most)
    reply = second(F.col("question"), F.col("reference_answer"), F.col("context")) if second else F.when(F.coalesce(F.col("context"), F.lit("")) == "", '{"category": "MISSING_EVIDENCE"}').otherwise('{"category": "RETRIEVAL_FAILURE"}')
    return first, pool.withColumn("category", category(reply)).withColumn("fixable", fixable(F.col("category")))


def ranks_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
