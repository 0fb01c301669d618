"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm import chat, decontaminate, fingerprints, hard_negatives, importance, kneser_ney, mixing, quality_rules, secrets, simhash, target_resampling, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_secret_scan": secrets.query,
        "op3_imatch_fingerprint": fingerprints.query,
        "op4_source_mixture": mixing.query,
        "op5_decontamination": decontaminate.query,
        "op6_kneser_ney": kneser_ney.query,
        "op7_toxicity": toxicity.query,
        "op8_chat_format": chat.query,
        "op9_token_counts": token_counts.query,
        "op10_importance_resampling": importance.query,
        "op11_quality_rules": quality_rules.query,
        "op12_target_resampling": target_resampling.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixture": mixing.sql(), "op5_decontamination": decontaminate.SQL, "op8_chat_format": chat.SQL, "op13_hard_negatives": hard_negatives.SQL}
