"""The steps that follow reranking, in this order: boost, section cap, paper cap, table merge, table injection, confidence.

Lists are (qid, chunk_id, ordinal, rank, score, score_kind, section, chunk_type,
text, caption) and, for caps by paper, paper_id; ``plans`` has qid, query_type,
cross_table and is_yes_no. Scores of injected tables are BM25 scores in a list of
pair scores, so score_kind is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.rules import METHOD_SECTION, found
from lumenq.functions.text import NUMBER
from lumenq.operators.chunking import merged_table
from lumenq.operators.fusion import capped

SECTION_CAP, YES_NO_K, WHY_HOW_K, BOOST = 2, 8, 7, 0.5
LIST = ["qid", "chunk_id", "ordinal", "rank", "score", "score_kind", "section", "chunk_type", "text", "caption"]


def effective_k(plan_type: Column, is_yes_no: Column, k: int) -> Column:
    """8 at least for yes/no questions, 7 at least for why and how."""
    return F.when(is_yes_no, F.greatest(F.lit(k), F.lit(YES_NO_K))).when(plan_type == "why_how", F.greatest(F.lit(k), F.lit(WHY_HOW_K))).otherwise(F.lit(k))


def is_table(chunk_type: Column) -> Column:
    return F.coalesce(chunk_type.isin("table", "merged_tables"), F.lit(False))


def has_number(text: Column) -> Column:
    return found(text, NUMBER)


def boosted(ranked: DataFrame, plans: DataFrame) -> DataFrame:
    """Half a point for method sections where the question is about methods, and a new order."""
    rows = ranked.join(plans.select("qid", F.col("query_type").alias("_type")), "qid", "left")
    gain = F.when((F.col("_type") == "methodology") & found(F.col("section"), METHOD_SECTION), F.lit(BOOST)).otherwise(F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("rank"))
    return rows.withColumn("score", F.col("score") + gain).withColumn("rank", F.row_number().over(w).cast("long")).drop("_type")


def reranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))


def with_merged_tables(ranked: DataFrame, tables: DataFrame, plans: DataFrame) -> DataFrame:
    """For questions over several tables: the two best become one composite at the head, followed by the non-tables.

    A list that has fewer than two tables takes them from ``tables``, a ranked list of table chunks.
    """
    cross = plans.where("cross_table").select("qid")
    mine = ranked.join(cross, "qid", "left_semi")
    rest = ranked.join(cross, "qid", "left_anti")
    own = mine.where(is_table(F.col("chunk_type")))
    more = tables.join(cross, "qid", "left_semi").join(own.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").where("rank <= 2")
    pool = reranked(own.select(*LIST).withColumn("_late", F.lit(0)).unionByName(more.select(*LIST).withColumn("_late", F.lit(1))), "_late", "rank")
    composite = merged_table(pool)
    heads = composite.select("qid", "chunk_id", F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("rank"), "score", F.lit("merged").alias("score_kind"), F.lit("").alias("section"), "chunk_type", "text", "caption")
    merged = mine.join(composite.select("qid"), "qid", "left_semi").where(~is_table(F.col("chunk_type")))
    plain = mine.join(composite.select("qid"), "qid", "left_anti")
    return reranked(merged.select(*LIST).unionByName(heads).unionByName(plain.select(*LIST)).unionByName(rest.select(*LIST)), "rank")


def with_table(ranked: DataFrame, tables: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """The list cut to its size, after the best table is put first where it needs one and has none.

    Numerical questions (not over several tables) take any table, comparisons one
    whose score is above 0. ``k_eff`` of ``plans``, if there, is the size; comparisons keep two rows at least.
    """
    size = F.coalesce(F.col("k_eff"), F.lit(k)) if "k_eff" in plans.columns else F.lit(k)
    asked = plans.select("qid", "query_type", "cross_table", size.alias("_k"))
    rows = ranked.join(asked, "qid")
    cut = rows.where((F.col("rank") <= F.col("_k")) | ((F.col("query_type") == "comparison") & (F.col("rank") <= 2)))
    have = cut.groupBy("qid").agg(F.max(is_table(F.col("chunk_type"))).alias("_table"))
    wants = asked.join(have, "qid").where(~F.col("_table") & ~F.col("cross_table") & F.col("query_type").isin("numerical", "comparison"))
    best = tables.where("rank = 1").join(wants, "qid").where((F.col("query_type") == "numerical") | (F.col("score") > 0))
    heads = best.withColumn("rank", F.lit(0).cast("long"))
    room = cut.join(best.select("qid").withColumn("_one", F.lit(1)), "qid", "left")
    kept = room.where(F.col("_one").isNull() | (F.col("rank") <= F.greatest(F.col("_k") - 1, F.lit(1))))
    return reranked(kept.select(*LIST).unionByName(heads.select(*LIST)), "rank")


def with_confidence(ranked: DataFrame, plans: DataFrame) -> DataFrame:
    """``low_confidence`` on the first row: a score below 0; for numbers none in the list; for comparisons fewer than two rows; over tables, none."""
    w = Window.partitionBy("qid")
    rows = ranked.join(plans.select("qid", "query_type", "cross_table"), "qid", "left")
    numbers, tables, n = F.max(has_number(F.col("text"))).over(w), F.max(is_table(F.col("chunk_type"))).over(w), F.count("*").over(w)
    low = (F.col("score") < 0) | ((F.col("query_type") == "numerical") & ~numbers) | ((F.col("query_type") == "comparison") & (n < 2)) | (F.coalesce(F.col("cross_table"), F.lit(False)) & ~tables)
    return rows.withColumn("low_confidence", F.when(F.col("rank") == 1, F.coalesce(low, F.lit(False)))).drop("query_type", "cross_table")


def postprocess(ranked: DataFrame, tables: DataFrame, plans: DataFrame, k: int = 5, by_paper: bool = False) -> DataFrame:
    """All steps in order. ``by_paper`` also puts one chunk of each paper first for comparisons."""
    sized = plans.withColumn("k_eff", effective_k(F.col("query_type"), F.col("is_yes_no"), k))
    out = capped(boosted(ranked, sized), "section", SECTION_CAP)
    if by_paper:
        compared = sized.where("query_type = 'comparison'").select("qid")
        out = capped(out.join(compared, "qid", "left_semi"), "paper_id", 1).unionByName(out.join(compared, "qid", "left_anti"))
    out = with_merged_tables(out, tables, sized)
    return with_confidence(with_table(out, tables, sized, k), sized)
