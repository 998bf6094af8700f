"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_template_compiler": ("chat", "op1"),
    "op2_segment_reassembly": ("warc", "op2"),
    "op3_minimax_shards": ("sharding", "op3"),
    "op4_kneser_ney_toxicity": ("toxicity", "op4"),
    "op5_mcd_outliers": ("quality", "op5"),
    "op6_field_over_leaf_blocks": ("html", "op6"),
    "op7_simhash_pivots": ("simhash", "op7"),
    "op8_sum_of_squares_packing": ("packing", "op8"),
    "op9_skip_chain_field": ("pii", "op9"),
    "op10_spaced_seed_decontamination": ("decontam", "op10"),
}


def _query(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {q: _query(*at) for q, at in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_template_compiler": _query("chat", "OP1_SQL"),
        "op2_segment_reassembly": _query("warc", "OP2_SQL"),
        "op10_spaced_seed_decontamination": _query("decontam", "OP10_SQL"),
    }
