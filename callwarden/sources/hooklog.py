"""Block-structured hook logs as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.functions.calls import BLANK

# --- fixed values: the log format -------------------------------------------------------
RECORD = r"(?U)^#(\d+)\s+\[([\d:.]+)\]\s+\[(H\d|META)\]\s+(.*?)(\s+<<敏感>>)?\s*$"
SESSION = r"(?U)^#\s*(S\d+)\s*·\s*(.+?)\s*$"
SEPARATOR = "-" * 90
PARAMS_MARK = "-- 参数内容"
STACK_MARK = "-- Java 调用栈"
THREAD_MARK = "-- 线程"
FRAME = r"(?U)^\s*\[(\d+)\]\s*(.*)$"
NO_STACK = "（无）"
#: Lines of a chunk where the source has none of its own.
CHUNK_LINES = 1 << 16


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, line_no, line): a file's splits are its chunks, and line_no ascends in each."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line_no"),
        F.regexp_replace("value", r"\r\z", "").alias("line"),
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Records of ordered lines: (file, rec, seq, time, category, name, marked, session, kv, stack).

    Session and record numbers are carried forward per file; a separator line closes a record.
    Lines are ordered by chunk and line_no; without chunks, ``CHUNK_LINES`` numbers make one. State
    runs inside chunks and goes from chunk to chunk by one row each.
    """
    if "chunk" not in lines.columns:
        lines = lines.withColumn("chunk", F.expr(f"line_no div {CHUNK_LINES}"))
    line = F.col("line")
    trimmed = F.btrim(line, F.lit(BLANK))
    is_session = trimmed.rlike(SESSION)
    head = line.rlike(RECORD) & ~is_session
    lines = lines.select("file", "chunk", "line_no", "line").withColumns(
        {
            "is_head": head,
            "own": F.when(is_session, F.regexp_extract(trimmed, SESSION, 1)),
            "edge": F.when(head, True).when(line.startswith(SEPARATOR), False),
        }
    )
    latest_of = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    chunks = lines.groupBy("file", "chunk").agg(
        latest_of("own").alias("own"), latest_of("edge").alias("edge"), F.count_if("is_head").alias("heads")
    )
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        F.col("file").alias("its_file"),
        F.col("chunk").alias("its_chunk"),
        F.last("own", True).over(before).alias("own_before"),
        F.last("edge", True).over(before).alias("edge_before"),
        F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("rec_before"),
    )
    sofar = Window.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumns(
        {
            "own": F.last("own", True).over(sofar),
            "edge": F.last("edge", True).over(sofar),
            "rec": F.sum(F.col("is_head").cast("int")).over(sofar),
        }
    ).join(carried, F.col("file").eqNullSafe(F.col("its_file")) & (F.col("chunk") == F.col("its_chunk")))
    df = df.withColumns(
        {
            "session": F.coalesce("own", "own_before"),
            "rec": F.col("rec") + F.col("rec_before"),
            "open": F.coalesce("edge", "edge_before"),
        }
    ).filter("rec > 0 and open")
    inside = Window.partitionBy("file", "rec").orderBy("chunk", "line_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    mark = (
        F.when(F.col("is_head"), "head")
        .when(line.contains(PARAMS_MARK), "params")
        .when(line.contains(STACK_MARK), "stack")
        .when(line.contains(THREAD_MARK), "thread")
    )
    df = df.withColumn("mark", mark).withColumn("section", F.last("mark", True).over(inside))
    body = F.col("mark").isNull() & ~trimmed.rlike(SESSION)
    key = F.btrim(F.substring_index(trimmed, ":", 1), F.lit(BLANK))
    value = F.btrim(F.regexp_replace(trimmed, "^[^:]*:", ""), F.lit(BLANK))
    pair = F.when(
        body & (F.col("section") == "params") & line.contains(":"),
        F.struct("chunk", "line_no", key.alias("k"), value.alias("v")),
    )
    counted = trimmed.startswith("共 ") & trimmed.contains("帧")
    frame = F.when(
        body
        & (F.col("section") == "stack")
        & ~counted
        & (trimmed != NO_STACK)
        & line.rlike(FRAME),
        F.struct("chunk", "line_no", F.btrim(F.regexp_extract(line, FRAME, 2), F.lit(BLANK)).alias("f")),
    )
    top = lambda c: F.max(F.when(F.col("is_head"), c))
    grouped = df.groupBy("file", "rec").agg(
        top(F.regexp_extract(line, RECORD, 1)).alias("seq"),
        top(F.regexp_extract(line, RECORD, 2)).alias("time"),
        top(F.regexp_extract(line, RECORD, 3)).alias("category"),
        top(F.regexp_extract(line, RECORD, 4)).alias("name"),
        top(F.regexp_extract(line, RECORD, 5) != "").alias("marked"),
        top(F.col("session")).alias("session"),
        F.array_sort(F.collect_list(pair)).alias("pairs"),
        F.array_sort(F.collect_list(frame)).alias("frames"),
    )
    # The last value of a repeated key wins: later entries are put first and kept.
    latest = F.aggregate(
        "pairs",
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])
        ),
    )
    return grouped.select(
        "file",
        "rec",
        "seq",
        "time",
        "category",
        "name",
        "marked",
        "session",
        latest.alias("kv"),
        F.transform("frames", lambda f: f["f"]).alias("stack"),
    )


def to_contract_text(records: DataFrame) -> DataFrame:
    """Add ``api``, ``sensitive``, ``n_stack`` and the three-segment ``text``.

    Parameters are merged as they stand; no signal is invented. Unreadable ones stay raw.
    """
    params, extra = F.col("kv")["params"], F.col("kv")["extra"]
    inner = lambda c: F.when(F.json_object_keys(c).isNotNull(), c)
    api = F.coalesce(F.col("kv")["api"], F.col("name"))
    sensitive = F.col("marked") | F.coalesce(F.col("kv")["sensitive"] == "True", F.lit(False))
    text_json = lambda c: F.regexp_replace(
        F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1"
    )
    own = ["_extra", "_api", "_category", "_sensitive"]
    readable = F.map_filter(
        F.from_json(params, "map<string,variant>", {"allowSingleQuotes": "false"}),
        lambda k, _: ~k.isin(own),
    )
    merged = F.transform(
        F.map_entries(readable),
        lambda e: F.concat(text_json(e["key"]), F.lit(": "), F.to_json(e["value"])),
    )
    parts = F.array_compact(
        F.concat(
            F.coalesce(
                F.when(inner(params).isNotNull(), merged),
                F.array(
                    F.when(
                        params.isNotNull() & F.try_parse_json(params).isNull() & (params != ""),
                        F.concat(F.lit('"_params_raw": '), text_json(params)),
                    )
                ),
            ),
            F.array(
                F.concat(F.lit('"_extra": '), inner(extra)),
                F.concat(F.lit('"_api": '), text_json(api)),
                F.concat(F.lit('"_category": '), text_json(F.col("category"))),
                F.when(sensitive, '"_sensitive": true'),
            ),
        )
    )
    stack = F.when(F.size("stack") > 0, F.array_join("stack", " <- ")).otherwise(NO_STACK)
    return records.withColumns(
        {
            "api": api,
            "sensitive": sensitive,
            "n_stack": F.size("stack"),
            "text": F.concat(
                F.lit("[platform=miniprogram]\nstack: "),
                stack,
                F.lit("\nparams: {"),
                F.array_join(parts, ", "),
                F.lit("}"),
            ),
        }
    )


def import_hook_log(spark: SparkSession, path: str) -> DataFrame:
    """Imported calls (id, session, category, api, sensitive, n_stack, text)."""
    records = to_contract_text(parse_log(read_lines(spark, path)))
    return records.select(
        F.col("seq").alias("id"), "session", "category", "api", "sensitive", "marked", "n_stack", "text"
    )


def import_stats(calls: DataFrame, top: int = 10) -> DataFrame:
    """Counts by category, the most frequent APIs, records with a stack, marked records."""
    row = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))
    by_category = calls.groupBy(F.col("category").alias("key")).agg(F.count("*").alias("n"))
    by_api = calls.groupBy(F.col("api").alias("key")).agg(F.count("*").alias("n"))
    totals = calls.agg(
        F.count_if(F.col("n_stack") > 0).alias("with_stack"), F.count_if("marked").alias("marked")
    ).select(
        F.inline(
            F.array(
                row("total", F.lit("with_stack"), F.col("with_stack")),
                row("total", F.lit("marked"), F.col("marked")),
            )
        )
    )
    label = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", "n")
    top_api = by_api.orderBy(F.desc("n"), "key").limit(top)
    return label(by_category, "category").unionByName(label(top_api, "api")).unionByName(totals)
