"""Queries of this package and their SQL, by name."""

from __future__ import annotations

import importlib

#: module and function of each query
NAMES = {
    "op1_factorisation_machine": "quality_fm",
    "op2_debruijn_compaction": "substring_words",
    "op3_bpe_prefix_dp": "bpe_dp",
    "op4_token_counts": "token_counts",
    "op5_simhash_tiles": "simhash",
    "op6_candidate_boosting": "pii",
    "op7_bwt_intervals": "substring_bytes",
    "op8_rank_order_language": "language_id",
    "op9_simhash_windows": "decontamination",
    "op10_weak_supervision": "weak_supervision",
    "op11_bit_sliced_negatives": "hard_negatives",
    "op12_markov_secrets": "secret_scan",
    "op13_merge_sort_windows": "rolling_ranks",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in sorted(set(NAMES.values())):
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", {})
    return out
