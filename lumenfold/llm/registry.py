"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, langid, lines, minhash, packing, pii, resampling, sharding, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_language_id": langid.op9_language_id,
    "op10_pii": pii.op10_pii,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_byte_bpe": bpe.op12_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": lines.OP4_SQL,
    "op6_minhash_near_dedup": minhash.OP6_SQL,
    "op7_benchmark_decontamination": decontam.OP7_SQL,
    "op8_nearest_neighbours": ann.OP8_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
}
