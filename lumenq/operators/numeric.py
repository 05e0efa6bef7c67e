"""Numbers in retrieved chunks, and simple reasoning over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions import rules as R
from lumenq.functions.text import NUMBER, numbers, parse_number, squeeze, tokens
from lumenq.operators.chunking import normalized_table

AROUND, METRIC_CHARS, LISTED, KEPT = 90, 140, 8, 50
_STOP = sorted("a an are average best by decrease did difference do does for gap highest how improvement in increase is lowest many maximum mean minimum much of on paper result score table the their they to was were what which with worst".split())
FACT_COLUMNS = ["qid", "chunk_id", "source_rank", "seq", "value", "raw_value", "metric", "row_label", "caption"]


def table_facts(ranked: DataFrame) -> DataFrame:
    """A row for each number in each cell of the ranked tables (qid, chunk_id, rank, text, caption, section, table_columns, table_rows)."""
    t = normalized_table(F.col("table_columns"), F.col("table_rows"), F.col("text"), most=1 << 30)
    rows = ranked.withColumn("_t", t).select("qid", "chunk_id", F.col("rank").cast("int").alias("source_rank"), F.coalesce("caption", "section", F.lit("")).alias("caption"), F.col("_t.columns").alias("head"), F.posexplode("_t.rows").alias("row_no", "row"))
    cells = rows.select("*", F.posexplode("row").alias("col_no", "cell"))
    found = cells.select("*", F.posexplode(numbers(F.col("cell"))).alias("no", "raw_value"))
    facts = found.select(
        "qid", "chunk_id", "source_rank", F.struct("row_no", "col_no", "no").alias("seq3"), parse_number(F.col("raw_value")).alias("value"), "raw_value",
        F.coalesce(F.get("head", F.col("col_no")), F.lit("")).alias("metric"), F.coalesce(F.get("row", F.lit(0)), F.lit("")).alias("row_label"), "caption",
    )
    seq = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("seq3"))
    return facts.where("value is not null").withColumn("seq", seq.cast("int")).select(*FACT_COLUMNS)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("context", T.StringType())])))
def _matches(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[dict]:
        t = t or ""
        return [{"raw": m.group(), "context": re.sub(r"\s+", " ", t[max(0, m.start() - AROUND) : m.end() + AROUND]).strip()[:METRIC_CHARS]} for m in re.finditer(NUMBER, t)]

    return texts.map(one)


def text_facts(ranked: DataFrame) -> DataFrame:
    """A row for each number in the ranked paragraphs; its metric is the text around it. Only texts with a digit go to Python."""
    some = ranked.where(F.col("text").rlike(r"\d"))
    found = some.select("qid", "chunk_id", F.col("rank").cast("int").alias("source_rank"), F.coalesce("caption", "section", F.lit("")).alias("caption"), F.posexplode(_matches("text")).alias("seq", "m"))
    facts = found.select("qid", "chunk_id", "source_rank", (F.col("seq") + 1).alias("seq"), parse_number(F.col("m.raw")).alias("value"), F.col("m.raw").alias("raw_value"), F.col("m.context").alias("metric"), F.lit("").alias("row_label"), "caption")
    return facts.where("value is not null").select(*FACT_COLUMNS)


def facts(ranked: DataFrame) -> DataFrame:
    table = F.coalesce(F.col("chunk_type").isin("table", "merged_tables"), F.lit(False))
    return table_facts(ranked.where(table)).unionByName(text_facts(ranked.where(~table)))


def terms(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(_STOP)))


def relevant(all_facts: DataFrame, questions: DataFrame) -> DataFrame:
    """The facts that share the most terms with their question (qid, question); all where none shares any."""
    both = all_facts.join(questions.select("qid", "question"), "qid")
    n = F.size(F.array_intersect(terms(F.col("question")), terms(F.concat_ws(" ", "metric", "row_label", "caption"))))
    return both.withColumn("overlap", n).withColumn("_most", F.max("overlap").over(Window.partitionBy("qid"))).where("overlap = _most").drop("_most")


def label(row_label: Column, metric: Column, caption: Column, chunk_id: Column) -> Column:
    named = F.array_join(F.filter(F.array(row_label, metric), lambda x: x != ""), " / ")
    return F.when(named != "", named).when(caption != "", caption).otherwise(chunk_id)


def candidates(selected: DataFrame) -> DataFrame:
    """For each question the candidate maximum, minimum, mean and difference of its selected facts; of equal values the first."""
    order = (F.col("source_rank").cast("long") * 1_000_000 + F.col("seq")).alias("o")
    named = selected.withColumn("label", label(F.col("row_label"), F.col("metric"), F.col("caption"), F.col("chunk_id"))).withColumn("o", order)
    high, low = F.max_by(F.struct("raw_value", "label", "source_rank", "value"), F.struct("value", -F.col("o"))), F.min_by(F.struct("raw_value", "label", "source_rank", "value"), F.struct("value", "o"))
    out = named.groupBy("qid", "question").agg(F.count("*").alias("n"), high.alias("high"), low.alias("low"), F.avg("value").alias("mean"))
    q = F.col("question")
    return out.select(
        "qid", "n", F.when(R.found(q, R.HIGH), F.col("high.raw_value")).alias("max_raw"), F.when(R.found(q, R.HIGH), F.col("high.label")).alias("max_label"),
        F.when(R.found(q, R.LOW), F.col("low.raw_value")).alias("min_raw"), F.when(R.found(q, R.LOW), F.col("low.label")).alias("min_label"),
        F.when(R.found(q, R.AVERAGE), F.round("mean", 6)).alias("mean"), F.when(R.found(q, R.DIFFERENCE) & (F.col("n") >= 2), F.round(F.col("high.value") - F.col("low.value"), 6)).alias("difference"),
    )


def notes(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, notes: one text for each numerical question (qid, question, query_type, needs_calculation); "None." for others."""
    found = facts(ranked)
    total = found.groupBy("qid").agg(F.count("*").alias("total"))
    chosen = relevant(found, questions)
    picked = candidates(chosen)
    each = chosen.withColumn("line", F.concat(F.lit("["), F.col("source_rank").cast("string"), F.lit("] "), label(F.col("row_label"), F.col("metric"), F.col("caption"), F.col("chunk_id")), F.lit(" = "), "raw_value"))
    lists = each.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "seq", "line"))), lambda x: x["line"]), "; ").alias("values"))
    both = questions.join(total, "qid", "left").join(picked, "qid", "left").join(lists, "qid", "left")
    text = F.concat_ws(
        "\n",
        F.format_string("%d numeric values in the sources; %d match the question best.", F.col("total"), F.col("n")),
        F.when(F.col("max_raw").isNotNull(), F.concat(F.lit("Candidate maximum: "), "max_raw", F.lit(" at "), "max_label")),
        F.when(F.col("min_raw").isNotNull(), F.concat(F.lit("Candidate minimum: "), "min_raw", F.lit(" at "), "min_label")),
        F.when(F.col("mean").isNotNull(), F.concat(F.lit("Candidate average: "), F.format_string("%s", F.col("mean")))),
        F.when(F.col("difference").isNotNull(), F.concat(F.lit("Candidate difference: "), F.format_string("%s", F.col("difference")))),
        F.when(F.col("n") <= LISTED, F.concat(F.lit("Values: "), "values")),
    )
    wants = (F.col("query_type") == "numerical") | F.coalesce(F.col("needs_calculation"), F.lit(False))
    return both.select("qid", F.when(~wants, "None.").when(F.col("total").isNull(), "No numeric values in the sources.").otherwise(text).alias("notes"))


def context(c: Column) -> Column:
    return squeeze(c)
