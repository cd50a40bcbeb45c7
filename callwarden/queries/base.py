"""Inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.functions import policy, signals
from callwarden.operators import derived
from callwarden.operators.staging import seal, spread
from callwarden.plans.classify import SEGMENTS, SIGNALS, classify_calls, with_segments


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return derived.hook_calls(spread(table(spark, sf, "events")))


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return seal(with_segments(calls(spark, sf)), "platform", "stack", "body")


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    return signals.normalize_signals(signals.parse_signals(segmented(spark, sf)))


def verdicts(spark: SparkSession, sf: str, cfg=None, order=None) -> DataFrame:
    return classify_calls(calls(spark, sf), cfg, order)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Truth label: the policy applied to the true type."""
    df = signalled(spark, sf).withColumn(
        "t", policy.decide_ex(F.col("true_dt"), F.col("malformed"))
    )
    return df.select("id", F.col("t.violation").alias("true_violation"))


def labelled_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with their segments, signals and truth label, unjudged."""
    df = signalled(spark, sf)
    truth = policy.decide_ex(F.col("true_dt"), F.col("malformed"))["violation"]
    return seal(df.withColumn("true_violation", truth), "true_violation")


def labelled_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts beside the truth label, from one pass over the calls that reads their signals once."""
    df = classify_calls(labelled_calls(spark, sf), ready=True)
    return df.drop(*SEGMENTS, *SIGNALS)
