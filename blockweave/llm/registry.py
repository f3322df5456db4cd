"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import exact_dedup, lang_id, mixing, packing, pii, simhash, substring_dedup, token_counts, toxicity, vp_search


def queries() -> dict:
    """One query for each operator, over its whole table."""
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_language_id": lang_id.op3_language_id,
        "op4_packing": packing.op4_packing,
        "op5_vp_search": vp_search.op5_vp_search,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_pii": pii.op7_pii,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op2_substring_dedup": substring_dedup.SQL, "op5_vp_search": vp_search.SQL, "op8_mixing": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL}
