"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quipu.llm import brown, decontam, divergence, langid, licences, media, mixing, neardup, pii, quality, resampling, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_licences": licences.op2_licences,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_id": langid.op5_language_id,
    "op6_brown_lm": brown.op6_brown_lm,
    "op7_pii": pii.op7_pii,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_media": media.op9_media,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_resampling": resampling.op11_resampling,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL: dict[str, str] = {
    "op2_licences": licences.OP2_SQL,
    "op3_decontamination": decontam.OP3_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op12_suffix_dedup": suffixes.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
