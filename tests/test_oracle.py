"""Registered queries against DuckDB on the smallest scale.

A core subset by default; CALLWARDEN_ALL=1 runs every registered query.
"""

import math
import os

import duckdb
import pytest

from callwarden.queries.registry import registered

SF = os.environ.get("CALLWARDEN_SF", "/root/testdata/sf0.001")
CORE = [
    "call_segments", "signal_types", "signal_salvage", "flatten_json", "declaration_shapes",
    "type_evidence", "payload_disambiguation", "policy_verdicts", "empty_scope_checks", "classify",
    "contradiction_revocation", "leak_by_platform", "funnel", "crc_thresholds", "certificate_check",
    "catalog_collisions", "hook_log_import", "scrub_documents", "value_shapes_documents",
    "disguised_numbers", "split_numbers", "structural_reasons", "token_decoding",
    "restored_calls", "bayes_languages", "scores_softmax", "scrub_call_params", "code_words",
    "pii_scan_documents", "call_files", "event_files", "certificate_files", "revocation_files",
    "hook_log_files", "token_parts", "top_events",
]
NAMES = list(registered()) if os.environ.get("CALLWARDEN_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def canonical(rows):
    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        try:
            number = float(v)
        except (TypeError, ValueError):
            return str(v)
        return "nan" if math.isnan(number) else round(number, 6)

    return sorted(([value(v) for v in row] for row in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    query, sql = registered()[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = canonical([row[c] for c in columns] for row in df.collect())
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = canonical([row[names.index(c)] for c in columns] for row in result.fetchall())
    assert got == want
