"""Contract signals: parsing with salvage, and normalisation to strict types.

Absent, JSON null and wrongly typed stay three different things: an absent key has no
entry in ``present``, the other two are listed in ``malformed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.functions.calls import BLANK
from callwarden.functions.consts import known, per_session, strings
from callwarden.operators.staging import seal

VARIANT_DDL = ", ".join(f"{k} variant" for k in vocab.SIGNAL_KEYS)


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


@per_session
def _parse_columns(body: str) -> tuple[Column, Column, Column, Column]:
    """(variants, salvaged text, present keys, parsed) of a body, given ``object_keys``."""
    is_object = F.col("object_keys").isNotNull()
    pick = [
        F.when(
            ~is_object & F.col(body).rlike(rf'(?U)"{k}"\s*:'),
            F.btrim(
                _trimmed(
                    F.regexp_extract(body, rf'(?U)"{k}"\s*:\s*(\[[^\]]*\]|"?[^,}}]*"?)', 1)
                ),
                F.lit('"'),
            ),
        )
        for k in vocab.SIGNAL_KEYS
    ]
    names = strings(vocab.SIGNAL_KEYS)
    raw = F.from_json(body, VARIANT_DDL, {"allowSingleQuotes": "false"})
    salvaged = F.when(
        ~is_object,
        F.map_filter(F.map_from_arrays(names, F.array(*pick)), lambda _, v: v.isNotNull()),
    )
    present = F.when(is_object, F.array_intersect(names, F.col("object_keys"))).otherwise(
        F.coalesce(F.map_keys("salvaged"), F.array().cast("array<string>"))
    )
    return raw, salvaged, present, is_object | (F.size("present") > 0)


def parse_signals(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``object_keys``, ``raw`` (struct of variants), ``salvaged``, ``present``, ``parsed_ok``.

    A JSON object prefix is enough. Bodies that are no object are searched key by key.
    """
    raw, salvaged, present, parsed = _parse_columns(body)
    df = df.withColumn("object_keys", F.json_object_keys(body))
    df = df.withColumns({"raw": raw, "salvaged": salvaged})
    return df.withColumn("present", present).withColumn("parsed_ok", parsed)


def _typed(key: str) -> Column:
    """Struct (kind, text): type name and text of one signal, found once per row."""
    is_object = F.col("object_keys").isNotNull()
    value = F.col(f"raw.{key}")
    kind = F.when(is_object, F.coalesce(F.schema_of_variant(value), F.lit("VOID"))).otherwise("STRING")
    text = F.when(is_object, value.cast("string")).otherwise(F.element_at("salvaged", F.lit(key)))
    present = F.array_contains("present", F.lit(key))
    return F.when(present, F.struct(kind.alias("kind"), text.alias("text"))).alias(key)


#: Typed texts in two columns: compiled as one, the method is too long for the JVM to compile it further.
HALVES = (vocab.SIGNAL_KEYS[: len(vocab.SIGNAL_KEYS) // 2], vocab.SIGNAL_KEYS[len(vocab.SIGNAL_KEYS) // 2 :])


def _normal(key: str) -> tuple[Column, Column]:
    """(typed value or NULL, text is of an accepted type) of one signal."""
    half = "_typed0" if key in HALVES[0] else "_typed1"
    kind, text = F.col(f"{half}.{key}.kind"), F.col(f"{half}.{key}.text")
    is_text = kind == "STRING"
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if key in vocab.BOOL_SIGNALS:
        word = F.lower(_trimmed(text))
        yes = ((kind == "BOOLEAN") & (text == "true")) | (is_text & word.isin(vocab.TRUE_WORDS))
        no = ((kind == "BOOLEAN") & (text == "false")) | (is_text & word.isin(vocab.FALSE_WORDS))
        yes = yes | ((kind == "BIGINT") & (text == "1"))
        no = no | ((kind == "BIGINT") & (text == "0"))
        value = F.when(yes, F.lit(True)).when(no, F.lit(False))
        return value, yes | no
    if key == "retention_days":
        fits = (kind == "BIGINT") | (is_text & _trimmed(text).rlike(r"^-?\d+$"))
        return F.when(fits, F.try_to_number(_trimmed(text), F.lit("S9999999999999999999"))), fits
    if key == "consent_scope":
        listed = F.expr("try_variant_get(raw.consent_scope, '$', 'array<string>')")
        all_text = (kind == "ARRAY<STRING>") & F.get(F.sort_array(listed), F.lit(0)).isNotNull()
        empty = kind.startswith("ARRAY") & (text == "[]")
        split = F.filter(
            F.transform(F.split(text, ","), _trimmed), lambda x: x != ""
        )
        value = (
            F.when(is_text, split).when(empty, F.array().cast("array<string>")).when(all_text, listed)
        )
        return value, is_text | empty | all_text
    return F.when(is_text | number, text), is_text | number


@per_session
def _normal_columns() -> tuple[list[Column], Column, Column]:
    """(typed texts in halves, normalised struct, malformed keys)."""
    values, bad = [], []
    for key in vocab.SIGNAL_KEYS:
        value, fits = _normal(key)
        present = F.array_contains("present", F.lit(key))
        if key == "retention_days":
            value = value.cast("bigint")
        values.append(F.when(present, value).alias(key))
        bad.append(F.when(present & ~F.coalesce(fits, F.lit(False)), F.lit(key)))
    typed = [F.struct(*[_typed(key) for key in half]) for half in HALVES]
    return typed, F.struct(*values), known(*bad)


def normalize_signals(df: DataFrame) -> DataFrame:
    """Add ``sig`` (struct of typed signals) and ``malformed`` (keys in contract order)."""
    typed, sig, malformed = _normal_columns()
    df = seal(df.withColumn("_typed0", typed[0]), "_typed0").withColumn("_typed1", typed[1])
    return df.withColumns({"sig": sig, "malformed": malformed}).drop("_typed0", "_typed1")


def payload_keys() -> Column:
    """Top-level keys that are no contract signal."""
    return F.array_except("object_keys", strings(vocab.SIGNAL_KEYS))


def missing_signals() -> Column:
    return F.array_except(strings(vocab.SIGNAL_KEYS), F.col("present"))
