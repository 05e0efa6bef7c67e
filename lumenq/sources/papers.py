"""Papers from JSON, demo documents, and the library's tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq import schema
from lumenq.operators.chunking import MIN_CHARS, paper_chunks
from lumenq.sources import markup


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a JSON object keyed by paper id: paper_id, ordinal (its place in the file), title, abstract, full_text, qas. Missing keys are empty."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.posexplode(F.map_entries(F.from_json("value", schema.PAPERS))).alias("ordinal", "e"))
    empty_text, empty_qas = (F.array().cast(schema.PAPER[c].dataType) for c in ("full_text", "qas"))
    return each.select(
        F.col("e.key").alias("paper_id"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("e.value.title", F.lit("")).alias("title"), F.coalesce("e.value.abstract", F.lit("")).alias("abstract"),
        F.coalesce("e.value.full_text", empty_text).alias("full_text"), F.coalesce("e.value.qas", empty_qas).alias("qas"),
    )


def read_demo(spark: SparkSession, glob: str) -> DataFrame:
    """Demo documents (metadata and chunks), one JSON object a file; files that can't be read are left out."""
    kind = "metadata struct<title:string,abstract:string,paper_id:string>, chunks array<struct<chunk_id:string,section:string,text:string,chunk_type:string>>"
    return spark.read.schema(kind).json(glob, multiLine=True, mode="DROPMALFORMED").withColumn("file", F.col("_metadata.file_name")).where("chunks is not null")


def library_tables(papers: DataFrame, vectors: DataFrame | None = None, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The library's chunks and papers. Vectors join by chunk id, never by place; a chunk without one has null.

    Papers carry their abstract (500 characters) and number of chunks, counted in one aggregation.
    """
    chunks = paper_chunks(papers, min_chars).withColumn("index_text", F.col("text"))
    if vectors is not None:
        chunks = chunks.join(vectors.select("chunk_id", "vec"), "chunk_id", "left")
    counts = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"))
    listed = papers.join(counts, "paper_id").select("paper_id", "ordinal", "title", F.substring("abstract", 1, 500).alias("abstract"), "n_chunks")
    return chunks, listed


def write_library(chunks: DataFrame, papers: DataFrame, path: str) -> None:
    """Chunks, laid out by paper so that a search in a few papers reads a few files' row groups, and papers."""
    chunks.repartitionByRange("paper_id").sortWithinPartitions("paper_id", "ordinal").write.mode("overwrite").parquet(f"{path}/chunks")
    papers.write.mode("overwrite").parquet(f"{path}/papers")


def read_library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/papers")


def corpus_hash(chunks: DataFrame) -> DataFrame:
    """One row: a hash of ids and lengths, whatever the order, by which stored vectors are known to fit; and the number of chunks."""
    return chunks.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha1(F.concat_ws("|", "chunk_id", F.length("text"))), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def build_library(files: DataFrame, to_tei: Callable[[bytes], str], path: str, min_chars: int = MIN_CHARS) -> dict:
    """Writes a library of PDF files (path, content): ``chunks``, ``papers``, ``_rejects`` and ``build_log``, and returns the log.

    Files are parsed once; what comes of it is written before it is split.
    """
    spark, began = files.sparkSession, time.time()
    markup.parse_library(files, to_tei, min_chars).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/_parsed")
    took = time.time() - began
    parsed = spark.read.schema(f"{markup.LIBRARY}, kind string").parquet(f"{path}/_parsed")
    papers = parsed.where("kind = 'paper'").select("paper_id", F.xxhash64("paper_id").alias("ordinal"), "title", F.substring("abstract", 1, 500).alias("abstract"), "n_chunks")
    titles = papers.select("paper_id", F.col("title").alias("paper_title"))
    chunks = parsed.where("kind = 'chunk'").drop("kind", "title", "abstract", "n_chunks", "error", "path").join(titles, "paper_id")
    write_library(chunks, papers, path)
    rejects = parsed.where("kind = 'reject'").select("path", "error")
    rejects.write.mode("overwrite").parquet(f"{path}/_rejects")
    n = {r["kind"]: r["count"] for r in parsed.groupBy("kind").count().collect()}
    log = {"n_papers": n.get("paper", 0), "n_chunks": n.get("chunk", 0), "n_failed": n.get("reject", 0), "parse_time_s": round(took, 1)}
    spark.createDataFrame([tuple(log.values())], "n_papers long, n_chunks long, n_failed long, parse_time_s double").coalesce(1).write.mode("overwrite").json(f"{path}/build_log")
    return log


def vectors_for(chunks: DataFrame, stored: str, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """(chunk_id, vec) of the chunks, and whether they were there: stored vectors are taken only if they were made for the same ids and lengths, else they are made and stored with their fingerprint."""
    spark = chunks.sparkSession
    own = corpus_hash(chunks).first()
    where = f"{stored}/{own.n}-{own.fingerprint}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there:
        encode(chunks).select("chunk_id", "vec").write.mode("overwrite").parquet(where)
    return spark.read.parquet(where), there
