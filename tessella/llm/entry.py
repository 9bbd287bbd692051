"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

#: Module and function of each query.
LISTED = {
    "op1_token_frames": "tokens",
    "op2_minhash_forest": "minhash",
    "op3_simhash_leaks": "decontaminate",
    "op4_chat_segments": "chat",
    "op5_kd_shards": "shards",
    "op6_super_kmers": "substrings",
    "op7_quality_cascade": "quality",
    "op8_pfair_mix": "mixing",
    "op9_toxicity": "toxicity",
    "op10_main_text": "html",
}


def queries() -> dict:
    found = {}
    for name, module in LISTED.items():
        found[name] = getattr(importlib.import_module(f"tessella.llm.{module}"), name)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in dict.fromkeys(LISTED.values()):
        found |= getattr(importlib.import_module(f"tessella.llm.{module}"), "ORACLE_SQL", {})
    return found
