"""Exact quantiles against sorted lists, with few cuts and small leaves so that rounds happen."""

import math
import random

import pytest

from callwarden.operators.learn import rank_in_field
from callwarden.operators.quantiles import exact_quantiles

SHARES = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}


def nearest_rank(values, p):
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    return ordered[max(math.ceil(len(ordered) * p), 1) - 1]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(11)
    return {
        "even": [rng.random() for _ in range(300)],
        "wide": [math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]) for _ in range(300)],
        "hot": [5.0] * 280 + [rng.random() for _ in range(10)] + [9.0, 9.5],
        "one": [7.25],
        "nan": [1.0, 2.0, float("nan"), float("nan"), 3.0, float("inf"), float("-inf")],
        None: [3.0, 1.0, 2.0, 2.0],
        "all_nan": [float("nan")] * 3,
    }


@pytest.mark.parametrize("cuts,leaf", [(3, 8), (64, 100_000)])
def test_equal_to_sorted_lists(spark, groups, cuts, leaf):
    rows = [(g, v) for g, values in groups.items() for v in values] + [("empty", None), ("one", None)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", SHARES, cuts, leaf).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in SHARES.items():
            want = nearest_rank(values, p)
            assert got[g][name] == want or (math.isnan(want) and math.isnan(got[g][name])), (g, name)


def test_no_groups_and_no_rows(spark, groups):
    df = spark.createDataFrame([(v,) for v in groups["hot"]], "v double")
    assert [tuple(r) for r in exact_quantiles(df, [], "v", {"p50": 0.5}, 3, 8).collect()] == [(5.0,)]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), [], "v", {"p50": 0.5}).collect()] == [(None,)]
    assert exact_quantiles(df.limit(0).selectExpr("1 AS g", "v"), ["g"], "v", {"p50": 0.5}).collect() == []


def test_all_values_are_coded_over_ranges(spark):
    rng = random.Random(4)
    rows = [(f, f"v{i}", rng.choice([1, 1, 1, 2, 9])) for f, k in (("a", 900), ("b", 3), ("c", 400)) for i in range(k)]
    got = rank_in_field(spark.createDataFrame(rows, "field string, value string, n long")).collect()
    assert len({r["code"] for r in got if r["field"] == "a"}) == 900 and len(got) == len(rows)
    for field in "abc":
        ordered = sorted((r for r in rows if r[0] == field), key=lambda r: (-r[2], r[1]))
        assert {r["value"]: r["code"] for r in got if r["field"] == field} == {r[1]: i for i, r in enumerate(ordered)}
