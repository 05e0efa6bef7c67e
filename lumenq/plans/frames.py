"""How the given tables stand in for papers, chunks, questions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.operators.chunking import line_chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks."""
    return line_chunks(table(spark, sf_dir, "documents"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; those with pipes as tables, and their source as section."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("text").contains("|"), "table").otherwise("paragraph")
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ordinal"), "text", F.col("source").alias("section"), kind.alias("chunk_type"), F.lit(None).cast("string").alias("caption"), "doc_id", "lang", "source")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text", "item_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents, by number."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vec"))


def items_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    return items(spark, sf_dir).join(v, "item_id").select("qid", "text", "item_id", "qvec")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for the router: the labelled synthetic ones, and the ASCII turns of users in conversations."""
    from lumenq.operators.router import synthetic_questions

    turns = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & ~F.col("text").rlike(r"[^\x00-\x7f]"))
    own = turns.select(F.lit(None).cast("string").alias("label"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("question"))
    return synthetic_questions(spark).unionByName(own)


def balance_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structured table of customers and balances for each nation, as retrieved chunks of one question each."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("a"), F.col("c_acctbal").cast("string").alias("b")))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["a"], x["b"]))
    n = F.col("c_nationkey").cast("string")
    return c.select(
        F.concat(F.lit("n"), n).alias("qid"), F.concat(F.lit("t"), n).alias("chunk_id"), F.lit(1).cast("long").alias("rank"), F.lit("").alias("text"), F.concat(F.lit("Balances of nation "), n).alias("caption"),
        F.lit(None).cast("string").alias("section"), F.array(F.lit("customer"), F.lit("balance")).alias("table_columns"), rows.alias("table_rows"), F.lit("table").alias("chunk_type"),
    )
