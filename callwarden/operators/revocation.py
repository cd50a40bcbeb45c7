"""Revocation: a declaration shape caught once is never trusted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_detections(df: DataFrame, detected: Column, pos: str = "pos") -> DataFrame:
    """(fingerprint, first_seen): partial aggregation keeps hot shapes small."""
    return df.filter(detected).groupBy("fingerprint").agg(F.min(pos).alias("first_seen"))


def mark_revoked(
    df: DataFrame,
    first: DataFrame,
    revoked: DataFrame | None = None,
    pos: str = "pos",
    salts: int = 16,
) -> DataFrame:
    """Add ``is_revoked``: an earlier row, or the stored table, caught this fingerprint.

    One shape may hold a third of all calls, so the call side is spread over ``salts`` and
    the side with one row per shape is repeated for each salt. No window gathers a shape.
    """
    stored = F.lit(False)
    first = first.select("fingerprint", "first_seen", F.lit(False).alias("stored"))
    if revoked is not None:
        old = revoked.select("fingerprint").distinct()
        old = old.select(
            "fingerprint",
            F.lit(None).cast(first.schema["first_seen"].dataType).alias("first_seen"),
            F.lit(True).alias("stored"),
        )
        first = first.unionByName(old)
        stored = F.coalesce("stored", F.lit(False))
    first = first.groupBy("fingerprint").agg(
        F.min("first_seen").alias("first_seen"), F.max("stored").alias("stored")
    )
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    df = df.withColumn("salt", F.pmod(F.xxhash64(pos), F.lit(salts)).cast("int"))
    joined = df.join(first, ["fingerprint", "salt"], "left")
    seen = stored | F.coalesce(F.col("first_seen") < F.col(pos), F.lit(False))
    return joined.withColumn("is_revoked", seen).drop("salt", "first_seen", "stored")


def new_revocations(detections: DataFrame, revoked: DataFrame) -> DataFrame:
    """Detections not stored yet, ready to append."""
    return detections.join(revoked.select("fingerprint"), "fingerprint", "left_anti")
