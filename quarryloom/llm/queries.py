"""The queries of the operators and of the pipeline, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_near_dedup", "op2_substring_dedup", "op3_packing", "op4_nearest", "op5_quality", "op6_token_counts", "op7_language_id", "op8_media_columns", "op9_bpe_codec", "op10_main_text", "op11_merkle_manifest", "op12_secret_scan", "op13_conversation_repair"]


def queries() -> dict:
    return {m: import_module(f".{m}", __package__).query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {m: getattr(import_module(f".{m}", __package__), "ORACLE_SQL", None) for m in MODULES}
    return {k: v for k, v in found.items() if v}
