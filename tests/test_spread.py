"""Calls are dealt over all cores, and evidence is computed only where it is asked for."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from callwarden.functions import sqlx
from callwarden.operators import events
from callwarden.operators.staging import with_texts
from callwarden.queries.base import spread


def _frame(master: str):
    context = SimpleNamespace(master=master, defaultParallelism=12)
    return SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), repartition=lambda n: n)


def test_calls_are_dealt_over_a_cluster_too():
    assert spread(_frame("local[8]")) == 12
    for master in ("local-cluster[3,4,10000]", "spark://host:7077", "yarn"):
        assert spread(_frame(master)) == 48
        light = _frame(master)
        assert spread(light, light=True) is light


def test_guarded_columns_are_not_computed_elsewhere(spark):
    wrong = sqlx.call("raise_error", "computed").cast("string")
    df = with_texts(spark.range(4), sqlx.col("id") > 5, x=wrong, y=sqlx.lit("kept"))
    assert [(r.x, r.y) for r in df.collect()] == [(None, None)] * 4


def test_samples_carry_columns_of_their_own_call(spark):
    """Two calls of one id stay two samples, each with its own timing."""
    trace = "named_struct('l2_guard', 'pass', 'l1', named_struct('combo', 'c', 'tier', 't', 'confidence', 1D, 'needs_review', false), 'l3', named_struct('kind', 'k', 'suggest', 's', 'confidence', 1D))"
    df = spark.range(2).select(
        F.lit(7).alias("id"), F.lit("x").alias("text"), F.expr(trace).alias("trace"), F.lit("NO_MASK").alias("decision"),
        F.lit("PHONE").alias("data_type"), F.lit(False).alias("needs_human"), F.lit("rules").alias("final_layer"),
        F.lit(None).cast("string").alias("review_reason"), F.col("id").alias("value"),
    )
    rows = events.decision_events(df, "meta", keep=("value",)).select("sid", "value").collect()
    assert sorted((r.sid, r.value) for r in rows) == [(7, 0), (7, 1)]
