"""Readers and writers over files that Spark writes to the shared folder first."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from callwarden.functions import calls as C
from callwarden.queries import report_queries
from callwarden.queries import oracle as D
from callwarden.queries.base import calls, segmented, table, verdicts
from callwarden.session import ensure_checkpoint_dir
from callwarden.sources import hooklog, tables


def _folder(spark) -> str:
    """A fresh folder on the shared location."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"files-{uuid.uuid4().hex}")


def call_files(spark, sf):
    """Calls written as JSON lines and read under their contract."""
    path = _folder(spark)
    calls(spark, sf).select(F.col("id").cast("string").alias("id"), "text").write.json(path)
    df = tables.read_calls(spark, path)
    return df.select("id", F.md5("text").alias("digest"), F.col("violation").isNull().alias("unlabelled"))


CALL_FILES = D.with_(D.CALLS) + "SELECT CAST(id AS VARCHAR) AS id, md5(text) AS digest, true AS unlabelled FROM calls"


def decision_files(spark, sf):
    """Decisions written by outcome, counted from the files."""
    path = _folder(spark)
    df = verdicts(spark, sf).select("id", "violation", "data_type", F.col("needs_review").alias("needs_human"))
    tables.write_decisions(df, path)
    back = spark.read.schema("id string, violation string, data_type string, outcome string").json(path)
    return back.groupBy("outcome", "violation").agg(F.count("*").alias("n"))


DECISION_FILES = D.with_(*D.VERDICT_CTES) + """
SELECT CASE WHEN needs_review THEN 'review' ELSE 'auto' END AS outcome, violation, count(*) AS n FROM verdicts GROUP BY 1, 2"""


def event_files(spark, sf):
    """An event log appended in two runs, with unreadable lines between, read back."""
    path = _folder(spark)
    ev = table(spark, sf, "events")
    rows = ev.select(F.col("event_id").alias("seq"), F.col("event_type").alias("ev"), F.col("user_id").cast("string").alias("sid"))
    tables.append_events(rows.filter("seq % 2 = 0"), path)
    tables.append_events(rows.filter("seq % 2 = 1"), path)
    broken = ev.filter("event_id % 50 = 0").select(F.concat(F.lit('{"seq": '), F.col("event_id").cast("string"), F.lit(', "ev": "cut')))
    broken.write.mode("append").text(path)
    df = tables.read_events(spark, path)
    return df.groupBy(F.coalesce("ev", F.lit("(unreadable)")).alias("ev")).agg(
        F.count("*").alias("n"), F.countDistinct("sid").alias("n_sid"), F.count("_bad").alias("n_bad")
    )


EVENT_FILES = """
SELECT event_type AS ev, count(*) AS n, count(DISTINCT user_id) AS n_sid, 0 AS n_bad FROM events GROUP BY 1
UNION ALL SELECT '(unreadable)', count(*), 0, count(*) FROM events WHERE event_id % 50 = 0 HAVING count(*) > 0"""


def certificate_files(spark, sf):
    """One certificate file for each of 30 groups of users; every third is broken, every third a list."""
    path = _folder(spark)
    groups = table(spark, sf, "events").groupBy((F.col("user_id") % 30).alias("k")).agg(F.count("*").cast("string").alias("n"))
    value = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"n": '), "n", F.lit("}"))).when(
        F.col("k") % 3 == 1, F.concat(F.lit("["), "n", F.lit("]"))
    ).otherwise(F.concat(F.lit('{"n": '), "n"))
    groups.select("k", value.alias("value")).repartition("k").write.partitionBy("k").text(path)
    df = tables.read_certificates(spark, f"{path}/*/*.txt")
    number = F.regexp_extract("certificate", "[0-9]+", 0).cast("long")
    return df.groupBy("state").agg(F.count("*").alias("files"), F.sum(number).alias("n"))


CERTIFICATE_FILES = """
SELECT CASE user_id % 30 % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'not_an_object' ELSE 'parse_error' END AS state,
  count(DISTINCT user_id % 30) AS files, count(*) AS n FROM events GROUP BY 1"""


def revocation_files(spark, sf):
    """Shapes of all calls, appended in two parts that share some of them, and loaded."""
    path = _folder(spark)
    shapes = segmented(spark, sf).select("id", C.declaration_fingerprint(F.col("text"), F.col("body")).alias("fingerprint"))
    nothing = spark.createDataFrame([], "fingerprint string")
    tables.append_revocations(shapes.filter("id % 3 = 0"), nothing, path)
    tables.append_revocations(shapes.filter("id % 3 > 0"), tables.load_revocations(spark, path), path)
    return tables.load_revocations(spark, path).join(
        spark.read.json(path).groupBy("fingerprint").agg(F.count("*").alias("rows")), "fingerprint"
    )


REVOCATION_FILES = D.with_(*D.CALL_CTES) + """,
shapes AS (SELECT id, platform || '|empty=' || CASE WHEN contains(body, '"consent_scope": []') THEN '1' ELSE '0' END
   || '|' || array_to_string(list_sort(json_keys(body)), ',') AS fingerprint FROM seg)
SELECT DISTINCT fingerprint, 1 AS rows FROM shapes"""


def hook_log_files(spark, sf):
    """Block logs written as one file for each source and imported from there."""
    path = _folder(spark)
    lines = report_queries._log_lines(spark, sf)
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").text(path)
    df = hooklog.import_hook_log(spark, path)
    return df.select("id", "session", "category", "api", "sensitive", "n_stack", "text")


QUERIES = {
    "call_files": (call_files, CALL_FILES),
    "decision_files": (decision_files, DECISION_FILES),
    "event_files": (event_files, EVENT_FILES),
    "certificate_files": (certificate_files, CERTIFICATE_FILES),
    "revocation_files": (revocation_files, REVOCATION_FILES),
    "hook_log_files": (hook_log_files, report_queries.HOOK_LOG),
}
