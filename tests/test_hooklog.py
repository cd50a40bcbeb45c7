"""Block logs whose records and sessions run over the splits of a file."""

from pyspark.sql import functions as F

from callwarden.sources import hooklog


def _log():
    lines = []
    for i in range(300):
        if i % 70 == 0:
            lines.append(f"# S{i} · session {i}")
        lines += [f"#{i} [10:00:{i % 60:02d}] [H1] api{i}", "  -- 参数内容", f"  api: api{i}", "  k: first", f"  k: {i}", "  -- Java 调用栈"]
        lines += [f"    [{k}] frame{i}_{k}" for k in range(i % 7)] + ["-" * 90, "    [9] beyond the record"]
    return lines


def test_a_file_is_read_in_splits_and_records_run_over_them(spark, tmp_path):
    (tmp_path / "hook.txt").write_text("\r\n".join(_log()), encoding="utf-8")
    small = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        lines = hooklog.read_lines(spark, str(tmp_path))
        assert lines.select("file", "chunk").distinct().count() > 20
        rows = hooklog.parse_log(lines).orderBy("rec").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [(r.rec, r.seq, r.session) for r in rows] == [(i + 1, str(i), f"S{i // 70 * 70}") for i in range(300)]
    assert [r.kv for r in rows] == [{"api": f"api{i}", "k": str(i)} for i in range(300)]
    assert [r.stack for r in rows] == [[f"frame{i}_{k}" for k in range(i % 7)] for i in range(300)]


def test_chunks_of_a_table_do_not_change_records(spark, monkeypatch):
    table = spark.createDataFrame(list(enumerate(_log())), "line_no long, line string").withColumn("file", F.lit("f"))
    whole = sorted(map(str, hooklog.parse_log(table).collect()))
    monkeypatch.setattr(hooklog, "CHUNK_LINES", 7)
    assert sorted(map(str, hooklog.parse_log(table).collect())) == whole and len(whole) == 300
