"""The revocation stream judges every call once and dealt over all cores, with the results of the batch job."""

from callwarden.config import AuditConfig
from callwarden.operators import derived
from callwarden.plans.classify import classify_calls
from callwarden.streaming import streams

SF = "/root/testdata/sf0.001"
CFG = AuditConfig(audit_key="audit-demo-key", audit_permille=250)


def test_a_batch_is_judged_once_and_dealt(spark, tmp_path, monkeypatch):
    calls = derived.hook_calls(spark.read.parquet(f"{SF}/events.parquet")).select("id", "ts", "text")
    calls.coalesce(1).write.parquet(f"{tmp_path}/calls")
    judged = []

    def once(df, cfg):
        judged.append(df.rdd.getNumPartitions())
        return row_verdicts(df, cfg)

    row_verdicts = streams.row_verdicts
    monkeypatch.setattr(streams, "row_verdicts", once)
    stored = spark.read.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/calls")
    streams.revocation_stream(
        stream, f"{tmp_path}/verdicts", f"{tmp_path}/shapes", f"{tmp_path}/state", CFG, ["ts", "id"]
    ).awaitTermination()
    assert judged == [spark.sparkContext.defaultParallelism]
    columns = ["id", "data_type", "violation", "tier", "needs_review", "review_reason", "combo"]
    got = spark.read.parquet(f"{tmp_path}/verdicts").select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, classify_calls(stored, CFG, ["ts", "id"]).select(*columns).collect()))
