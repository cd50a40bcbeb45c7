"""Row work of a verdict is compiled: no lambda walks it as a tree, and hits stay as they were."""

from pyspark.sql import functions as F

from callwarden.functions import calls, signals, text
from callwarden.functions.consts import known
from callwarden.operators import identify


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_known_leaves_out_nulls_and_keeps_the_order(spark):
    df = spark.range(1).select(known(F.lit("b"), F.lit(None).cast("string"), F.lit("a")).alias("v"))
    assert df.first().v == ["b", "a"]
    df = spark.range(1).select(known(F.lit(None).cast("string")).alias("v"))
    assert df.first().v == []


def test_signals_guard_and_fingerprint_have_no_lambda(spark):
    df = spark.createDataFrame([("[platform=ios]", '{"crypto": 1, "b": 2, "a": 3}')], "text string, body string")
    shape = df.select(calls.declaration_fingerprint(F.col("text"), F.col("body")).alias("v"))
    assert "lambda" not in _plan(shape)
    assert shape.first().v == "ios|empty=0|a,b,crypto"
    malformed = signals._normal_columns()[2]
    assert "array_compact" not in str(malformed) and "filter" not in str(malformed).lower()
    assert "array_compact" not in str(text.guard_residual(F.col("text")))


def test_lists_with_null_members_stay_malformed(spark):
    rows = [(1, '{"consent_scope": ["NAME", null]}'), (2, '{"consent_scope": ["NAME", "NAME"]}'), (3, '{"consent_scope": []}'), (4, '{"consent_scope": [null]}')]
    df = spark.createDataFrame(rows, "id int, body string")
    found = signals.normalize_signals(signals.parse_signals(df)).select("id", "sig.consent_scope", "malformed").orderBy("id").collect()
    assert [(r.consent_scope, r.malformed) for r in found] == [
        (None, ["consent_scope"]), (["NAME", "NAME"], []), ([], []), (None, ["consent_scope"]),
    ]


def test_matched_hits_keep_catalogue_order_and_suppress_substrings(spark):
    rows = [("ios", "NAME", "long.token.read"), ("ios", "SMS", "token.read"), ("android", "SMS", "other.call")]
    data = [(1, "ios", "x Long Token Read y"), (2, None, "a.token.read other.call"), (3, "android", "token.read"), (4, "ios", None)]
    df = spark.createDataFrame(data, "id int, platform string, stack string")
    found = identify.match_catalog(df, rows).orderBy("id").collect()
    names = lambda hits: [(h.variant, h.types) for h in hits]
    assert [names(r.matched) for r in found] == [
        [("long token read", ["NAME"]), ("token read", ["SMS"])], [("other.call", ["SMS"]), ("token.read", ["SMS"])], [], [],
    ]
    assert names(found[0].kept) == [("long token read", ["NAME"])] and names(found[0].suppressed) == [("token read", ["SMS"])]
    assert names(found[1].kept) == names(found[1].matched) and not found[1].suppressed
    plan = identify.match_catalog(df, rows).select("matched")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan.lower()
