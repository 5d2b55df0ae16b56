"""The text operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolane.llm import audit, chat, fingerprint, packing, pii, quality, rules, sentencepiece_scan, sharding, simhash, spelling, substring, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
        "op4_sentencepiece": sentencepiece_scan.op4_sentencepiece,
        "op5_warc": warc.op5_warc,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_contextual_pii": pii.op10_contextual_pii,
        "op11_sharding": sharding.op11_sharding,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": rules.ORACLE_SQL,
        "op11_sharding": sharding.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_filter_audit": audit.ORACLE_SQL,
    }
