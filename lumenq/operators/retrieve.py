"""Retrieval strategies over batches of questions, by name, and search over a library of papers.

Each strategy takes a ``Corpus`` and questions (qid, text, qvec) and returns
(qid, chunk_id, ordinal, rank, score, score_kind).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.text import tokens
from lumenq.operators import bm25, dense, fusion, postings, rewrite, router
from lumenq.operators.postprocess import LIST, effective_k, is_table, postprocess
from lumenq.operators.rerank import PairScorer, listed, overlap_f1, rerank

POOL, TOP_K = 50, 5
TWO_STAGE_PAPERS, TOP_PAPERS, BM25_WEIGHT, DENSE_WEIGHT = 500, 8, 1.0, 0.6
ANCHOR_STOP = sorted("about and are does for from how its method model paper papers that the this using what which why with work".split())


@dataclass
class Corpus:
    """Chunks, their vectors (chunk_id, ordinal, vec), how pairs are scored, and lists of questions that several searches begin with."""

    chunks: DataFrame
    vectors: DataFrame
    scorer: PairScorer = overlap_f1
    index: bm25.Index | None = None
    lists: tuple[DataFrame, int, DataFrame, DataFrame] | None = None

    def shared(self, q: DataFrame, k: int) -> Corpus:
        """With an index whose counts are made once, and both lists of the k best of each question, whose beginnings are those of fewer."""
        index = self.index or bm25.Index(self.chunks)
        return replace(self, index=index, lists=(q, k, bm25.retrieve(index, q, k), dense.retrieve(self.vectors, q, k)))


def by_bm25(c: Corpus, q: DataFrame, k: int = TOP_K) -> DataFrame:
    if c.lists and c.lists[0] is q and k <= c.lists[1]:
        return c.lists[2].where(F.col("rank") <= k)
    return bm25.retrieve(c.index or c.chunks, q, k)


def by_dense(c: Corpus, q: DataFrame, k: int = TOP_K) -> DataFrame:
    if c.lists and c.lists[0] is q and k <= c.lists[1]:
        return c.lists[3].where(F.col("rank") <= k)
    return dense.retrieve(c.vectors, q, k)


def by_rrf(c: Corpus, q: DataFrame, k: int = TOP_K, candidates: int = fusion.CANDIDATES) -> DataFrame:
    return fusion.rrf([(by_bm25(c, q, candidates), 1.0), (by_dense(c, q, candidates), 1.0)], k)


def by_pair(c: Corpus, q: DataFrame, k: int = TOP_K, pool: int = POOL) -> DataFrame:
    """BM25's pool, reranked; the vectors play no part."""
    return rerank(by_bm25(c, q, pool), q, c.chunks, k, c.scorer)


def by_rrf_pair(c: Corpus, q: DataFrame, k: int = TOP_K, pool: int = POOL) -> DataFrame:
    return rerank(by_rrf(c, q, pool), q, c.chunks, k, c.scorer)


def variant_lists(c: Corpus, q: DataFrame, k: int = fusion.CANDIDATES) -> DataFrame:
    """(qid, variant, chunk_id, ordinal, rank): reciprocal rank fusion for each variant of each question.

    Questions have ``variants``; without it they are routed first. A variant's vector is its question's unless it has one.
    """
    have = q if "variants" in q.columns else q.withColumn("variants", rewrite.of_plan(F.col("text"), router.route(F.col("text"))))
    # routing is costly to compile and the questions are few against the chunks, so it is done once
    each = have.select("qid", "qvec", F.posexplode("variants").alias("variant", "text")).withColumn("vid", F.concat("qid", F.lit("#"), F.col("variant").cast("string"))).persist()
    lists = by_rrf(c, each.select(F.col("vid").alias("qid"), "text", "qvec"), k, k)
    return lists.withColumnRenamed("qid", "vid").join(each.select("vid", "qid", "variant"), "vid").select("qid", "variant", "chunk_id", "ordinal", "rank")


def by_multi_query(c: Corpus, q: DataFrame, k: int = TOP_K) -> DataFrame:
    return fusion.multi_query_rrf(variant_lists(c, q), k)


def by_multi_query_pair(c: Corpus, q: DataFrame, k: int = TOP_K, pool: int = POOL) -> DataFrame:
    """Variants fused to a pool, reranked against the original question."""
    return rerank(by_multi_query(c, q, pool), q, c.chunks, k, c.scorer)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"BM25": by_bm25, "Dense": by_dense, "RRF": by_rrf, "CE": by_pair, "RRF+CE": by_rrf_pair, "Fusion+CE": by_multi_query_pair}


def run_strategies(c: Corpus, q: DataFrame, names: list[str] | None = None, k: int = TOP_K) -> DataFrame:
    """The lists of several strategies, with a ``strategy`` column. An unknown name raises ValueError."""
    names = list(STRATEGIES) if names is None else names
    wrong = [n for n in names if n not in STRATEGIES]
    if wrong:
        raise ValueError(f"unknown strategies: {', '.join(wrong)}")
    c, out = c.shared(q, max(k, fusion.CANDIDATES)) if len(names) > 1 else c, None
    for n in names:
        rows = STRATEGIES[n](c, q, k).withColumn("strategy", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def within_paper(c: Corpus, q: DataFrame, k: int = TOP_K, paper: str = "paper_id") -> dict[str, DataFrame]:
    """BM25, Dense, RRF over all of a paper, and that reranked, each within the question's paper, whose chunks are a collection of their own."""
    own = c.chunks.select(paper, "chunk_id", "ordinal").join(q.select("qid", paper), paper)
    full = bm25.Index(c.chunks, scope=paper).all(q)
    if full is None:
        found = bm25.scores(c.chunks, q, (paper,))
        full = own.join(found.select("qid", "chunk_id", "score"), ["qid", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    lex = bm25.top(full, 1 << 30)
    vec = own.join(c.vectors.select("chunk_id", "vec"), "chunk_id").join(q.select("qid", "qvec"), "qid")
    sem = bm25.top(vec.select("qid", "chunk_id", "ordinal", dense.dot(F.col("vec"), F.col("qvec")).alias("score")), 1 << 30)
    rrf = fusion.rrf([(lex, 1.0), (sem, 1.0)])
    pool = rrf.where(F.col("rank") <= POOL)
    shape = ["qid", "chunk_id", "ordinal", "rank", "score"]
    return {"BM25": lex.where(F.col("rank") <= k).select(*shape), "Dense": sem.where(F.col("rank") <= k).select(*shape), "RRF": rrf.where(F.col("rank") <= k).select(*shape), "CE": rerank(pool, q, c.chunks, k, c.scorer).select(*shape)}


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """A list with the columns that postprocessing reads; those that chunks lack are null."""
    have = {f: F.col(f) if f in chunks.columns else F.lit(None).cast("string").alias(f) for f in ("section", "chunk_type", "text", "caption")}
    extra = [x for x in ("paper_id", "doc_id") if x in chunks.columns]
    return ranked.join(listed(chunks, ranked).select("chunk_id", *have.values(), *extra), "chunk_id").select(*LIST, *extra)


def tables_by_bm25(chunks: DataFrame, q: DataFrame, k: int = 2) -> DataFrame:
    """The best tables of each question, indexed among tables only."""
    only = chunks.where(is_table(F.col("chunk_type")))
    return with_chunks(bm25.top(bm25.best(only, q, k), k).withColumn("score_kind", F.lit("bm25")), only)


def paper_search(c: Corpus, q: DataFrame, plans: DataFrame, k: int = TOP_K, pool: int | None = None) -> DataFrame:
    """The single-paper pipeline: BM25, reranking of the pool (all chunks by default), and every postprocessing step."""
    ranked = rerank(bm25.retrieve(c.chunks, q, pool or 1 << 30), q, c.chunks, None, c.scorer)
    return postprocess(with_chunks(ranked, c.chunks), tables_by_bm25(c.chunks, q), plans, k)


def multi_query_search(c: Corpus, q: DataFrame, plans: DataFrame, k: int = TOP_K) -> DataFrame:
    """Variants' pools of max(20, 8 k), united with the first seen kept, reranked against the question and postprocessed without the table merge."""
    each = q.select("qid", F.posexplode("variants").alias("variant", "text")).withColumn("vid", F.concat("qid", F.lit("#"), F.col("variant").cast("string")))
    lists = bm25.retrieve(c.chunks, each.select(F.col("vid").alias("qid"), "text"), max(20, 8 * k)).withColumnRenamed("qid", "vid").join(each.select("vid", "qid", "variant"), "vid")
    w = Window.partitionBy("qid", "chunk_id").orderBy("variant", "rank")
    first = lists.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    united = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("variant", "rank")).cast("long"))
    ranked = rerank(united, q, c.chunks, None, c.scorer)
    plain = plans.withColumn("cross_table", F.lit(False))
    return postprocess(with_chunks(ranked, c.chunks), tables_by_bm25(c.chunks, q), plain, k)


def anchor_terms(text):
    """Tokens of three letters or more that aren't common in questions."""
    return F.array_except(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 3)), F.array(*[F.lit(w) for w in ANCHOR_STOP]))


def paper_scores(chunk_scores: DataFrame, papers: DataFrame, q: DataFrame, top: int = TOP_PAPERS) -> DataFrame:
    """(qid, paper_id, rank, score): the best papers by their best chunk and by title and abstract.

    ``chunk_scores`` has qid, paper_id and BM25 scores; papers have paper_id, title, abstract, ordinal. With anchor
    terms: a quarter of the best chunk, twice the paper's own score and once more for a title hit, a tenth of that
    if no anchor is in the paper's text; without them, the sum.
    """
    best = chunk_scores.groupBy("qid", "paper_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    text = F.concat_ws(" ", "title", "abstract")
    as_chunks = papers.select(F.col("paper_id").alias("chunk_id"), "ordinal", text.alias("text"))
    own = bm25.scores(as_chunks, q, distinct=True).select("qid", F.col("chunk_id").alias("paper_id"), F.col("score").alias("own"))
    named = papers.select("paper_id", "ordinal", tokens(F.col("title")).alias("_title"), tokens(text).alias("_all"))
    pairs = best.join(own, ["qid", "paper_id"], "full").join(named, "paper_id").join(q.select("qid", anchor_terms(F.col("text")).alias("_anchors")), "qid")
    b, p = F.coalesce("best", F.lit(0.0)), F.coalesce("own", F.lit(0.0))
    title = F.when(F.arrays_overlap("_anchors", "_title"), p).otherwise(0.0)
    anchored = (0.25 * b + 2.0 * p + title) * F.when(F.arrays_overlap("_anchors", "_all"), 1.0).otherwise(0.1)
    scored = pairs.select("qid", "paper_id", "ordinal", F.when(F.size("_anchors") > 0, anchored).otherwise(b + p).alias("score"))
    return bm25.top(scored, top).select("qid", "paper_id", "ordinal", "rank", "score")


#: Questions whose best chunk scores are kept for each paper in an array.
MAX_ASKED = 4096


def _weighed(b, p, in_title, there, anchored):
    """The score of papers x questions, as ``paper_scores`` has it."""
    return np.where(anchored, (0.25 * b + 2.0 * p + np.where(in_title, p, 0.0)) * np.where(there, 1.0, 0.1), b + p)


def best_papers(index: bm25.Index, papers: DataFrame, q: DataFrame, top: int = TOP_PAPERS) -> DataFrame:
    """``paper_scores`` over an index of chunks (with paper_id), without a row for each question and chunk: a paper has its best chunk's scores for all questions in an array, and each task hands on its best papers."""
    text = F.concat_ws(" ", "title", "abstract")
    have = papers.where(F.col("paper_id").isNotNull()).select(F.col("paper_id").alias("chunk_id"), "ordinal", text.alias("text"), "title")
    of_chunks, of_papers = index.sides(q), bm25.Index(have, distinct=True).sides(q)
    if of_chunks is None or of_papers is None or sum(len(s.qids) for s in of_papers.get("", [])) > MAX_ASKED:
        return paper_scores(bm25.scores(index.chunks, q, keep=("paper_id",)), papers, q, top)
    anchors = {r.qid: r.anchors for r in q.select(F.col("qid").cast("string").alias("qid"), anchor_terms(F.col("text")).alias("anchors")).collect()}
    best = postings.best_of_groups(index.rows("paper_id", together="paper_id"), "paper_id", of_chunks.get("", []), bm25.K1, bm25.B) if of_chunks else None
    if best is None:
        return paper_scores(bm25.scores(index.chunks, q, keep=("paper_id",)), papers, q, top)
    lists = best.groupBy(F.col("paper_id").alias("chunk_id")).agg(F.collect_list("best").alias("__best"))
    joined = have.select("chunk_id", "ordinal", F.col("text").alias("__text"), F.col("title").alias("__title")).join(lists, "chunk_id", "left")
    found = postings.best_papers(joined, top, of_papers[""], anchors, bm25.K1, bm25.B, _weighed)
    return bm25.top(found, top).select("qid", F.col("chunk_id").alias("paper_id"), "ordinal", "rank", "score").persist()


def library_single(c: Corpus, q: DataFrame, plans: DataFrame, k: int = TOP_K) -> DataFrame:
    """BM25 and dense lists fused with weights 1.0 and 0.6, a pool of 50 reranked, and postprocessed."""
    fused = fusion.rrf([(bm25.retrieve(c.chunks, q, POOL), BM25_WEIGHT), (dense.retrieve(c.vectors, q, POOL), DENSE_WEIGHT)], POOL)
    ranked = rerank(fused, q, c.chunks, None, c.scorer)
    return postprocess(with_chunks(ranked, c.chunks), tables_by_bm25(c.chunks, q), plans, k, by_paper=True)


def library_two_stage(c: Corpus, papers: DataFrame, q: DataFrame, plans: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best papers first, then all their chunks reranked, the best of each paper together, and postprocessed."""
    index = bm25.Index(c.chunks)
    chosen = best_papers(index, papers, q)
    inside = c.chunks.join(F.broadcast(chosen.select("paper_id").distinct()), "paper_id", "left_semi").persist()
    asked = q.join(chosen.select("qid", "paper_id"), "qid")
    scored = bm25.Index(inside, within="paper_id", counts=index).all(asked)
    if scored is None:
        found = bm25.scores(c.chunks, q, keep=("paper_id",)).select("qid", "chunk_id", "score")
        own = inside.select("chunk_id", "ordinal", "paper_id").join(asked.select("qid", "paper_id"), "paper_id")
        scored = own.join(found, ["qid", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranked = rerank(bm25.top(scored, 1 << 30).persist(), q, inside, None, c.scorer).persist()
    sized = plans.select("qid", effective_k(F.col("query_type"), F.col("is_yes_no"), k).alias("_k"))
    per = with_chunks(ranked, inside).join(sized, "qid").withColumn("_n", F.row_number().over(Window.partitionBy("qid", "paper_id").orderBy("rank"))).where("_n <= _k").drop("_n", "_k")
    return postprocess(per, tables_by_bm25(c.chunks, q), plans, k, by_paper=True)


def library_search(c: Corpus, papers: DataFrame, q: DataFrame, plans: DataFrame, k: int = TOP_K, threshold: int = TWO_STAGE_PAPERS) -> DataFrame:
    """Two stages from more than ``threshold`` papers on, one below."""
    many = papers.limit(threshold + 1).count() > threshold
    return library_two_stage(c, papers, q, plans, k) if many else library_single(c, q, plans, k)


def library_stats(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: papers, chunks, tables, and chunks a paper."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(is_table(F.col("chunk_type"))).alias("n_tables")).crossJoin(papers.agg(F.count("*").alias("n_papers"))).withColumn("chunks_per_paper", F.round(F.col("n_chunks") / F.col("n_papers"), 6))


def paper_list(papers: DataFrame) -> DataFrame:
    """The library's papers with all that is known of each, in their order."""
    return papers.orderBy("ordinal") if "ordinal" in papers.columns else papers.orderBy("paper_id")
