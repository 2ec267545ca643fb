"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetrina.llm import bpe, chat, exact_dedup, hard_negatives, licenses, packing, quality_model, quality_rules, secret_scan, simhash, substring_dedup, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op4_chat_format": chat.op4_chat_format,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_url_filter": urls.op8_url_filter,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_suffix_array_dedup": substring_dedup.op10_suffix_array_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
