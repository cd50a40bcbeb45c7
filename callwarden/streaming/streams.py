"""Calls as streams: verdicts, revocation that survives restarts, contradiction monitor."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.config import AuditConfig
from callwarden.operators import revocation
from callwarden.operators.staging import spread
from callwarden.plans.classify import row_verdicts, settle

FINGERPRINTS = "fingerprint string"


def classify_stream(calls: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """Row-local verdicts of a stream; the same code as the batch job, without revocation."""
    return row_verdicts(calls, cfg or AuditConfig())


def stored_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Revocation table at ``path``; empty before the first append."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], FINGERPRINTS)
    return spark.read.schema(FINGERPRINTS).parquet(path)


def revocation_stream(
    calls: DataFrame, sink: str, store: str, checkpoint: str, cfg: AuditConfig, order: list[str]
):
    """Start the stream that never trusts a caught declaration shape again.

    Each micro-batch reads the stored shapes, classifies, and writes verdicts and new shapes
    under its batch number, so a replayed batch overwrites itself instead of repeating. Calls are dealt over
    all cores, as a batch has few files, and judged once: their row verdicts are written beside the
    stream's state, under one of two names in turn, as revocation reads them twice. Within
    a batch, ``order`` decides what came first. The shapes live in a table, not in operator
    state: one shape may hold a third of all calls and must not become one state key.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = stored_fingerprints(spark, store)
        rows = os.path.join(f"{checkpoint}-rows", str(number % 2))
        row_verdicts(spread(batch), cfg).write.mode("overwrite").parquet(rows)
        verdicts = settle(spark.read.parquet(rows), cfg, order, known)
        verdicts.write.mode("overwrite").parquet(os.path.join(sink, f"batch={number}"))
        written = spark.read.parquet(os.path.join(sink, f"batch={number}"))
        fresh = written.filter("detected").select("fingerprint").distinct()
        fresh = revocation.new_revocations(fresh, known.distinct())
        fresh.write.mode("overwrite").parquet(os.path.join(store, f"batch={number}"))

    return (
        calls.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def contradiction_monitor(
    verdicts: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours"
) -> DataFrame:
    """Share of self-contradicting and reviewed calls per window; batch or stream alike."""
    hit = F.coalesce(F.col("review_reason").contains("contract_scope_contradiction"), F.lit(False))
    source = verdicts.withWatermark(ts, late) if verdicts.isStreaming else verdicts
    return (
        source.groupBy(F.window(ts, size).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(hit).alias("n_conflict"),
            F.count_if("needs_review").alias("n_review"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "n",
            "n_conflict",
            "n_review",
            (F.col("n_review") / F.col("n")).alias("review_share"),
        )
    )
