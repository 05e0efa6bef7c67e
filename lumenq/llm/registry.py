"""Queries of the corpus operators, one ``opN_*`` each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import bitpack, bpe, imatch, jaccard, langid, packing, pii, sharding, warc, webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_bitpack": bitpack.query,
    "op2_bpe_chunk_reuse": bpe.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_mincost_reshard": sharding.query,
    "op5_min_bin_slack": packing.query,
    "op6_webp_lossless": webp.query,
    "op7_warc_writer": warc.query,
    "op8_imatch": imatch.query,
    "op9_feistel_pii": pii.query,
    "op10_ecoc_langid": langid.query,
}

ORACLES: dict[str, str] = {"op6_webp_lossless": webp.ORACLE_SQL, "op8_imatch": imatch.ORACLE_SQL}
