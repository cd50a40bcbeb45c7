"""Readers and writers of calls, events, certificates and revocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "id string, text string, violation string, data_type string"
EVENTS = (
    "seq long, ts string, t_wall double, run string, ev string, sid string, api string, "
    "text_len long, input_sha1 string, text string, outcome string, l2_guard string, "
    "l1_combo string, l1_tier string, l1_confidence double, l1_needs_review boolean, "
    "l3_kind string, l3_combo string, l3_confidence double, decision string, data_type string, "
    "needs_human boolean, final_layer string, review_reason string, ms map<string,double>, "
    "stage string, err_type string, err string, kind string, available boolean, note string, "
    "tool string, input string, n long, backend string, env map<string,string>, _bad string"
)


def read_calls(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Calls as JSON lines; blank lines are skipped."""
    df = spark.read.schema(CALLS).json(path)
    return df.limit(limit) if limit else df


def write_decisions(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One row per call, laid out by outcome."""
    outcome = F.when(F.col("needs_human"), "review").otherwise("auto")
    df.withColumn("outcome", outcome).write.partitionBy("outcome").format(fmt).save(path)


def read_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Audit events; unreadable lines keep their first 200 characters in ``_bad``."""
    reader = spark.read.schema(EVENTS).option("columnNameOfCorruptRecord", "_bad")
    df = reader.option("mode", "PERMISSIVE").json(path)
    df = df.withColumn("_bad", F.substring("_bad", 1, 200))
    return df.limit(limit) if limit else df


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with ``state``: present, parse_error or not_an_object."""
    df = spark.read.option("wholetext", "true").text(path)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("certificate"))
    parsed = F.try_parse_json("certificate")
    state = F.when(parsed.isNull(), "parse_error").when(
        ~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object"
    )
    return df.withColumn("state", state.otherwise("present"))


def load_revocations(spark: SparkSession, path: str) -> DataFrame:
    """Stored fingerprints from a list or a ``{"revoked": [...]}`` document, or JSON rows."""
    text = spark.read.option("wholetext", "true").text(path)
    listed = F.coalesce(
        F.from_json("value", "array<string>"),
        F.from_json("value", "revoked array<string>")["revoked"],
    )
    rows = F.transform(
        F.filter(F.split("value", "\n"), lambda line: line.startswith('{"fingerprint"')),
        lambda line: F.get_json_object(line, "$.fingerprint"),
    )
    found = F.when(F.size(rows) > 0, rows).otherwise(listed)
    return text.select(F.explode(found).alias("fingerprint")).distinct()


def append_revocations(detections: DataFrame, stored: DataFrame, path: str) -> None:
    """Append fingerprints that are not stored yet."""
    fresh = detections.select("fingerprint").distinct().join(stored, "fingerprint", "left_anti")
    fresh.write.mode("append").json(path)
