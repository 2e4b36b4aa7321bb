"""Queries of the corpus operators by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorfisc.llm import ann, exact, extraction, language, mixing, packing, repair, sharding, simhash, spelling, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (simhash.op1_simhash_dedup, mixing.op2_mix_sources, ann.op3_ann, extraction.op4_html_extraction, sharding.op5_shard_documents, tokens.op6_token_counts, language.op7_language_id, toxicity.op8_toxicity, packing.op9_pack_documents, exact.op10_exact_topk, repair.op11_conversation_repair, spelling.op12_spelling_variants, warc.op13_warc_revisits)}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others are tested against brute force, the library or held-out rows."""
    return {"op10_exact_topk": exact.ORACLE, "op13_warc_revisits": warc.ORACLE}
