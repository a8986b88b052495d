"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import archives, bpe, containment, hard_negatives, jaccard_join, language_id, manifest, personal, quality_crf, quality_rules, secrets, sharding, token_counts

_MODULES = {
    "op1_token_counts": token_counts,
    "op2_sharding": sharding,
    "op3_warc": archives,
    "op4_bpe": bpe,
    "op5_quality_crf": quality_crf,
    "op6_language_id": language_id,
    "op7_secret_scan": secrets,
    "op8_jaccard_join": jaccard_join,
    "op9_decontaminate": containment,
    "op10_quality_rules": quality_rules,
    "op11_personal_data": personal,
    "op12_hard_negatives": hard_negatives,
    "op13_manifest": manifest,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
