"""Exact nearest-rank quantiles with a state of fixed size for each group.

A group's rank is sought by rounds. A round cuts the values still in question at ``cuts`` splitters
(quantiles of a mergeable sketch, so the parts are even whatever the distribution), counts the parts
exactly and keeps the part that holds the rank. A splitter is a value of the group and has a part of
its own, so every round shrinks the part and a very common value ends the search at once. When no
part has over ``leaf`` values, they are counted one by one. 10^12 values take four rounds of 64 cuts.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.session import cut_lineage

CUTS = 64
LEAF = 100_000


def _same(by: list[str]) -> Column:
    return reduce(and_, [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.lit(True))


def _in_question(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Values inside the bracket of each sought rank, beside the rank's row."""
    inside = _same(by) & (F.col("v.t") >= F.col("s.lo")) & (F.col("v.t") <= F.col("s.hi"))
    joined = values.alias("v").join(state.alias("s"), inside)
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in state.columns], F.col("v.t").alias("t"))


def _narrow(values: DataFrame, state: DataFrame, by: list[str], cuts: int) -> DataFrame:
    """One round: the part of each bracket that holds the rank becomes the bracket."""
    key = [*by, "name"]
    shares = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    marks = (
        _in_question(values, state, by)
        .groupBy(*state.columns)
        .agg(F.array_distinct(F.percentile_approx("t", shares, F.lit(cuts * 16))).alias("marks"))
    )
    part = 2 * F.size(F.filter("marks", lambda m: m < F.col("t"))) + F.array_contains("marks", F.col("t")).cast("int")
    parts = (
        _in_question(values, marks, by)
        .groupBy(*key, "rank", "below", part.alias("part"))
        .agg(F.count("*").alias("inside"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    )
    upward = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.col("below") + F.sum("inside").over(upward))
    found = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("inside") < F.col("rank"))
    return parts.filter(found).select(
        *key, "rank", (F.col("upto") - F.col("inside")).alias("below"), "inside", "lo", "hi"
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, shares: dict[str, float], cuts: int = CUTS, leaf: int = LEAF
) -> DataFrame:
    """(by..., name..., one column for each share): the smallest value whose share is reached.

    NULL values don't count and a group without others has no row; NaN is the largest value. NULL
    groups are groups. Without ``by`` there is one row, of NULLs where nothing counts. ``df`` is read
    once; its two columns are kept on the checkpoint folder.
    """
    kept = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("t"))
    kept = cut_lineage(kept)
    values = kept.filter(~F.isnan("t"))
    number = F.when(~F.isnan("t"), F.col("t"))
    sizes = kept.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(number).alias("inside"), F.min(number).alias("lo"), F.max(number).alias("hi")
    ).filter("n > 0")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()])
    ranks = sizes.withColumn("w", F.explode(wanted)).select(
        *by,
        "w.name",
        F.greatest(F.ceil(F.col("n") * F.col("w.p")), F.lit(1)).alias("rank"),
        F.lit(0).cast("bigint").alias("below"),
        "inside", "lo", "hi",
    )
    state = cut_lineage(ranks)
    beyond = state.filter(F.col("rank") > F.col("inside")).select(*by, "name", F.lit(float("nan")).alias("t"))
    state = state.filter(F.col("rank") <= F.col("inside"))
    large = (F.col("inside") > leaf) & (F.col("lo") < F.col("hi"))
    while not state.filter(large).isEmpty():
        rest = state.filter(~large)
        state = cut_lineage(_narrow(values, state.filter(large), by, cuts).unionByName(rest))
    single = state.filter(F.col("lo") == F.col("hi")).select(*by, "name", F.col("lo").alias("t"))
    counted = (
        _in_question(values, state.filter(F.col("lo") < F.col("hi")), by)
        .groupBy(*by, "name", "rank", "below", "t")
        .agg(F.count("*").alias("k"))
    )
    upward = Window.partitionBy(*by, "name").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.col("below") + F.sum("k").over(upward))
    reached = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("k") < F.col("rank"))
    found = counted.filter(reached).select(*by, "name", "t").unionByName(single).unionByName(beyond)
    picked = [F.max(F.when(F.col("name") == name, F.col("t"))).alias(name) for name in shares]
    return found.groupBy(*by).agg(*picked)
