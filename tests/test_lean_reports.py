"""Reports compute nothing of a verdict that they don't read."""

import pytest
from pyspark.sql import functions as F

from callwarden.config import AuditConfig
from callwarden.functions import patterns as P
from callwarden.functions import signals
from callwarden.functions import text as X
from callwarden.operators import derived, identify, metrics, scan
from callwarden.plans.classify import classify_calls, with_segments
from callwarden.queries import base
from callwarden.queries import report_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stage_latency", "confidence_histogram", "run_overview", "error_summary", "backend_overview"])
def test_reports_without_decisions_judge_no_call(spark, monkeypatch, name):
    def judged(*_, **__):
        raise AssertionError("calls were judged")

    monkeypatch.setattr(Q, "run_funnel", judged)
    assert getattr(Q, name)(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["certificate_check", "group_certification", "class_balance"])
def test_tables_of_truth_labels_judge_no_call(spark, monkeypatch, name):
    def judged(*_, **__):
        raise AssertionError("calls were judged")

    monkeypatch.setattr(base, "classify_calls", judged)
    assert getattr(Q, name)(spark, SF).count() > 0


ODD = [
    None, "", "  ", "[platform=ios]", "ordinary", "zero​width", "tag\U000e0041", "pаypal", "а b64:AAAABBBBCCCC", "а 0x" + "ab" * 12,
    "а " + "Ab1" * 15, "а" + "Ab1" * 15, "x" * 39 + " Ab1", "Ab1" * 13, "Ab1" * 13 + "A", "é" + "Ab1" * 20, "a+/" * 20 + "==", "用户 50% а",
    "а " + "%41" * 8, "а " + "\\u0041" * 6, "sf:" + "A" * 8 + ":" + "B" * 8, "base64:AAAAAAAA", "_" + "Ab1" * 20,
]


def test_guard_marks_as_its_patterns_do(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    c = F.col("text")
    token = F.coalesce(c.rlike(P.RESIDUAL_TOKEN), F.lit(False))
    long = F.coalesce(c.rlike("(?U)" + P.BARE_BASE64), F.lit(False))
    rows = scan.input_guard(df).select(
        "*", X.residue_to_restore(c).alias("restore"), token.alias("token"), X.residual_token(c).alias("token_now"),
        long.alias("long"), c.rlike(P.BASE64_RUN).alias("run"),
    ).collect()
    assert {r.guard_action for r in rows} == {"pass", "preprocess", "review"}
    for r in rows:
        assert bool(r.restore) == (r.guard_action == "preprocess"), r
        assert bool(r.token_now) == r.token and (r.run or not r.long), r


def test_verdicts_from_signals_at_hand_are_the_same(spark):
    texts = [
        *[t for t in ODD if t is None or len(t) < 60],
        '[platform=android]\nstack: x.Tile.draw(X:1)\nparams: {"consent_scope": []}',
        '[platform=android]\nstack: TelephonyManager.getImei(T.java:1)\nparams: {"crypto":"none", "consent_state": 3}' + " " * 300,
        '[platform=android]\nstack: TelephonyManager.getImei(T.java:1)\nparams: {"crypto":"none", "consent_state": 3}',
        '[platform=ios]\nstack: CLLocationManager requestLocation\nparams: "pii_mask": "raw", "consent_scope": ["LOCATION"',
        '[platform=android]\nstack: x.Tile.draw(X:1)\nparams: {"consent_scope": [], "note": "13812345678"}' + " " * 300,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cfg = AuditConfig(max_text_chars=250)
    ready = signals.normalize_signals(signals.parse_signals(with_segments(df)))
    plain = classify_calls(df, cfg)
    out = classify_calls(ready, cfg, ready=True).select(*plain.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_compiled_methods_are_short_enough_for_the_jvm(spark):
    """HotSpot never compiles a method of more than 8,000 bytes; it interprets it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = spark.read.parquet(f"{SF}/events.parquet")
        calls = with_segments(derived.hook_calls(events))
        longest = {}
        for name, df in {
            "calls": derived.hook_calls(events),
            "catalogue": identify.match_catalog(calls, AuditConfig().catalog).select("matched"),
            "signals": signals.normalize_signals(signals.parse_signals(calls)).select("sig", "malformed"),
        }.items():
            stages = df._jdf.queryExecution().debug().codegenToSeq().iterator()
            longest[name] = 0
            while stages.hasNext():
                longest[name] = max(longest[name], stages.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(0 < size < 8000 for size in longest.values()), longest


def test_leak_examples_read_the_verdicts_once(spark):
    rows = [(i, i % 3 == 0, "COMPLIANT" if i % 2 else "WARNING", "NO_MASK", "t" * 200) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, needs_review boolean, violation string, true_violation string, text string")
    out = metrics.leak_examples(df)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.orderBy("path", "id").collect():
        got.setdefault(r.path, []).append(r.id)
        assert len(r.text) == 160
    assert got == {"violation_missed": [1, 5, 7, 11, 13], "violation_downgraded": [2, 4, 8, 10, 14]}
