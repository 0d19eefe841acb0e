"""The queries of this package and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from millrace.llm import decontamination, exact_dedup, language_id, licenses, mixing, near_dedup, quality, secrets, sharding, toxicity


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_licenses": licenses.op2_licenses,
        "op3_secrets": secrets.op3_secrets,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality": quality.op7_quality,
        "op8_language_id": language_id.op8_language_id,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.op1_sql(),
        "op2_licenses": licenses.op2_sql(),
        "op6_mixing": mixing.OP6_SQL,
        "op9_near_dedup": near_dedup.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
    }
