"""Queries of this subpackage with their DuckDB counterparts (None where SQL can't express one)."""

from __future__ import annotations

import importlib

MODULES = [
    "line_dedup", "sentencepiece_codec", "chat_format", "line_crf", "token_store", "shingle_join", "decontaminate", "pii", "language_id",
    "quality_rules", "structure_repair", "merkle_manifest", "embedding_near",
]


def registered() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for name in MODULES:
        found |= importlib.import_module(f"callwarden.llm.{name}").QUERIES
    return found
