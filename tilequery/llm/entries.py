"""Queries of the training-data operators for the driver, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, hard_negatives, id_files, importance, license_scan, near_dup, packing, quality_rules, suffix_dedup, token_counts, warc_fixity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_warc_fixity": warc_fixity.op4_warc_fixity,
    "op5_importance": importance.op5_importance,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_id_files": id_files.op11_id_files,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE,
    "op3_near_dup": near_dup.ORACLE,
    "op4_warc_fixity": warc_fixity.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
