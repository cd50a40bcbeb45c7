"""Jobs over text columns: guard, scrub, scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.functions import patterns as P
from callwarden.functions import text as X

PARAM_BLOCK = r"(?s)params:\s*(\{.*\})\s*$"


def input_guard(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``residual``, ``guard_action`` and ``suspected_encrypted``."""
    df = df.withColumn("residual", X.guard_residual(F.col(column)))
    return df.withColumns(
        {
            "guard_action": X.guard_action(F.col("residual")),
            "suspected_encrypted": F.array_contains("residual", "encoded_token"),
        }
    )


def pii_scan(df: DataFrame, column: str = "text", around: int = 12) -> DataFrame:
    """One row per hit: ``rule``, ``hit``, ``snippet`` plus the columns of ``df`` but the text.

    Hits of one rule are non-overlapping and the parts between them are kept, so every
    snippet is cut from exact offsets.
    """
    keep = [c for c in df.columns if c != column]
    text = F.col(column)
    found = []
    for name, pattern in X.scan_rules():
        full = "(?U)" + pattern
        hits = F.regexp_extract_all(text, F.lit(full), F.lit(0))
        if name == "blob":
            hits = F.transform(hits, lambda h: F.struct(h.alias("hit"), X.looks_like_blob(h, 20).alias("ok")))
        else:
            hits = F.transform(hits, lambda h: F.struct(h.alias("hit"), F.lit(True).alias("ok")))
        found.append(
            F.struct(
                F.lit(name).alias("rule"),
                hits.alias("hits"),
                F.split(text, full).alias("gaps"),
            )
        )
    df = df.select(*keep, F.explode(F.array(*found)).alias("r")).filter(F.size("r.hits") > 0)
    df = df.select(*keep, "r.rule", F.col("r.gaps").alias("gaps"), F.col("r.hits").alias("hits"))
    tail = lambda s: F.when(
        F.length(s) > around, F.substring(s, F.length(s) - around + 1, F.lit(around))
    ).otherwise(s)
    # The text between two hits may be shorter than the margin, so neighbours are pieced in.
    df = df.select(*keep, "rule", "gaps", "hits", F.posexplode("hits").alias("n", "one"))
    df = df.filter("one.ok")
    n = F.col("n")
    texts = F.transform("hits", lambda h: h["hit"])
    pieces = F.zip_with(
        "gaps", texts, lambda g, h: F.array(F.coalesce(g, F.lit("")), F.coalesce(h, F.lit("")))
    )
    before = F.concat(
        F.array_join(F.flatten(F.slice(pieces, F.greatest(n - 11, F.lit(1)), F.least(n, F.lit(12)))), ""),
        F.get("gaps", n),
    )
    rest = F.concat(
        F.coalesce(F.get("gaps", n + 1), F.lit("")),
        F.array_join(
            F.transform(
                F.sequence(n + 1, n + 12),
                lambda i: F.concat(
                    F.coalesce(F.get(texts, i), F.lit("")),
                    F.coalesce(F.get("gaps", i + 1), F.lit("")),
                ),
            ),
            "",
        ),
    )
    return df.select(
        *keep,
        "rule",
        F.col("one.hit").alias("hit"),
        F.concat(tail(before), F.col("one.hit"), F.substring(rest, 1, around)).alias("snippet"),
    )


def safe_json(value, depth: int):
    """JSON of a variant with every string made safe, item by item down to ``depth`` levels.

    Numbers, booleans and nulls stay as they are; what lies deeper is redacted whole.
    Keys of inner objects come in alphabetical order.
    """
    kind = F.schema_of_variant(value)
    plain = value.cast("string")
    safe = (
        F.when(kind == "STRING", _as_json(X.scrub_value(plain)))
        .when(kind == "VOID", "null")
        .when(kind.isin("BOOLEAN", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), plain)
    )
    if depth:
        items = F.transform(value.cast("array<variant>"), lambda v: F.coalesce(safe_json(v, depth - 1), F.lit("null")))
        pairs = F.transform(
            F.map_entries(value.cast("map<string,variant>")),
            lambda e: F.concat(_as_json(e["key"]), F.lit(": "), F.coalesce(safe_json(e["value"], depth - 1), F.lit("null"))),
        )
        safe = safe.when(kind.startswith("ARRAY"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
        safe = safe.when(kind.startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
    return safe.otherwise(_as_json(X.redacted(plain)))


def _as_json(s):
    return F.regexp_replace(F.to_json(F.struct(s.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def scrub_params(
    df: DataFrame, body: str = "body", max_keys: int | None = None, cap: int | None = None, depth: int = 3
) -> DataFrame:
    """Add ``scrubbed``: keys kept, values made safe, lists and objects item by item.

    Values under sensitive keys are redacted whole. ``max_keys`` keeps only the first keys and
    ``cap`` cuts a body that isn't an object; by default nothing is cut.
    """
    parsed = F.from_json(
        F.col(body), "map<string,string>", {"allowSingleQuotes": "false"}
    )
    kinds = F.from_json(F.col(body), "map<string,variant>", {"allowSingleQuotes": "false"})
    df = df.withColumns({"_m": parsed, "_k": kinds})

    def entry(key, value):
        kind = F.schema_of_variant(value)
        plain = F.when(kind == "BOOLEAN", F.initcap(value.cast("string"))).otherwise(value.cast("string"))
        masked = F.when(key.rlike(P.SENSITIVE_KEY), _as_json(X.redacted(F.coalesce(plain, F.lit("None")))))
        return F.concat(_as_json(key), F.lit(": "), F.coalesce(masked, safe_json(value, depth), F.lit("null")))

    held = F.map_entries("_k")
    held = held if max_keys is None else F.slice(held, 1, max_keys)
    entries = F.transform(held, lambda e: entry(e["key"], e["value"]))
    whole = F.when(
        F.col("_m").isNull(), X.scrub_str(F.col(body), cap)
    ).otherwise(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")))
    return df.withColumn("scrubbed", whole).drop("_m", "_k")


def scrub_text(df: DataFrame, column: str = "text", level: str = "safe", cap: int | None = None) -> DataFrame:
    """Add ``safe_text`` at one of the levels meta (nothing), safe, full (as it is).

    ``cap`` cuts the result to so many characters; by default nothing is cut.
    """
    text = F.col(column)
    if level == "meta":
        return df.withColumn("safe_text", F.lit(None).cast("string"))
    if level == "full" and cap is None:
        return df.withColumn("safe_text", text)
    if level == "full":
        cut = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("…<trunc>")))
        return df.withColumn("safe_text", F.coalesce(cut, text))
    parts = F.split(text, "\nparams:", 2)
    df = df.withColumns(
        {
            "_head": F.get(parts, F.lit(0)),
            "_tail": F.get(parts, F.lit(1)),
            "_body": F.regexp_extract(text, PARAM_BLOCK, 1),
        }
    )
    df = scrub_params(df, "_body", cap=cap)
    body = F.when(F.col("_body") != "", F.col("scrubbed")).otherwise(X.scrub_str(F.col("_tail"), cap))
    joined = F.when(
        F.col("_tail").isNotNull(), F.concat(F.col("_head"), F.lit("\nparams: "), body)
    ).otherwise(X.scrub_str(F.col("_head"), cap))
    return df.withColumn("safe_text", joined if cap is None else F.substring(joined, 1, cap)).drop(
        "_head", "_tail", "_body", "scrubbed"
    )
