"""A corpus pipeline of four stages: language, near duplicates, personal data, packing.

``STAGES`` has (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.llm import jaccard, langid, packing, pii
from lumenq.llm.shared import among, drop, table, without, written


def _apart(docs: DataFrame, made: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns that are named like an operator's under other names, and these: they come back as they were."""
    names = {c: f"__own_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(names), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; ``lang`` is the decision. Rejected ones (ambiguous, or no letters) go."""
    moved, names = _apart(docs, langid.MADE)
    judged = langid.identify(moved, langid.fit(table(spark, sf_dir, "documents")))
    kept = judged.where("accepted")
    return kept.select(*[F.col("pred_lang").alias("lang") if c == "lang" else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the least doc_id, once. Rows with a null doc_id stay.

    Where a doc_id has several texts, each is judged by itself. Rows of equal
    doc_id and text count once, whether they have partners or not; if their other
    columns differ, the row with the least of these (in the table's order) stays.
    """
    found = jaccard.groups(docs)
    gone = written(found.where("doc_id <> keeper or th <> keeper_th").select("doc_id", F.col("th").alias("__th")), "gone")
    twice = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select("doc_id"), "twice")
    once = without(docs, gone.select("doc_id").unionByName(twice), "doc_id").select(*docs.columns)
    if twice.isEmpty():
        return once
    left = among(docs, twice, "doc_id").withColumn("__th", F.xxhash64("text")).join(gone, ["doc_id", "__th"], "left_anti")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = left.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*rest or ["__th"]))).where("__k = 1")
    return once.unionByName(first.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data under pseudonyms."""
    moved, names = _apart(docs, ["n_pii"])
    return pii.pseudonymize(moved, pii.session_key()).select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left."""
    return packing.pack(docs)


STAGES = [("langid", language), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", packed)]

#: SQL has no n-gram classifiers or keyed permutations; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
