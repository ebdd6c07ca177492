"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, licenses, lm, quality_model, quality_rules, repair, resampling, secrets, sharding, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_lm_score": lm.op3_lm_score,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_quality": quality_model.op8_quality,
        "op9_simhash": simhash.op9_simhash,
        "op10_chat_format": chat.op10_chat_format,
        "op11_sharding": sharding.op11_sharding,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.OP2_SQL,
        "op10_chat_format": chat.OP10_SQL,
        "op12_conversation_repair": repair.OP12_SQL,
        "op13_resampling": resampling.OP13_SQL,
    }
