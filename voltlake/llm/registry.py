"""Queries and SQL of the text operators."""

from __future__ import annotations

import importlib

MODULES = ("license_scan", "decontaminate", "chat_format", "topk_search", "web_archive", "packing", "language_id", "toxicity", "jaccard_join", "suffix_dedup", "hash_forest", "conversation_repair", "merkle_manifest")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"voltlake.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"voltlake.llm.{name}").ORACLE
    return found
