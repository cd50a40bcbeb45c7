"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = ["call_queries", "report_queries", "text_queries", "model_queries", "source_queries", "label_queries", "codec_queries"]


def registered() -> dict[str, tuple]:
    """{name: (query, sql or None)}."""
    found: dict[str, tuple] = {}
    for name in MODULES:
        found |= importlib.import_module(f"callwarden.queries.{name}").QUERIES
    return found
