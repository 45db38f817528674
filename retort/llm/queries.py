"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, near_dedup, packing, pii, quality, sharding, substring_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_sharding": sharding.op2_sharding,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_packing": packing.op6_packing,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_quality": quality.op8_quality,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.OP2_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op5_near_dedup": near_dedup.OP5_SQL, "op9_substring_dedup": substring_dedup.OP9_SQL}
