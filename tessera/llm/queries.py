"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, jaccard, langid, packing, passages, quality, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op10_jaccard_join": jaccard.query,
    "op2_chat_format": chat.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_warc": warc.query,
    "op6_substring_dedup": passages.query,
    "op7_byte_bpe": bpe.query,
    "op8_topk": topk.query,
    "op9_quality_rules": quality.query,
}
ORACLES: dict[str, str] = {"op10_jaccard_join": jaccard.ORACLE_SQL, "op2_chat_format": chat.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op8_topk": topk.ORACLE_SQL}
