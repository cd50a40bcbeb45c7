"""The API catalogue as a table: sources, merging, collisions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.session import cut_lineage

CATALOG_SCHEMA = "platform string, data_type string, token string"


def api_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Catalogue rows; ``path`` names a JSON file of further (platform, data_type, token) rows."""
    base = spark.createDataFrame(vocab.catalog_rows(), CATALOG_SCHEMA)
    base = base.withColumn("cloud", F.col("token").isin(vocab.CLOUD_TOKENS))
    if path is None:
        return base
    more = spark.read.schema(CATALOG_SCHEMA).json(path)
    return base.unionByName(more.withColumn("cloud", F.col("token").isin(vocab.CLOUD_TOKENS)))


def with_sources(catalog: DataFrame, sources: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Catalogue rows with how many pages back their (platform, type), and an uncertain flag.

    The pages themselves stay in ``sources``, one row each.
    """
    pages = sources.distinct().groupBy("platform", "data_type").agg(F.count("url").alias("n_urls"))
    doubt = uncertain.select(F.lower("token").alias("low")).distinct().withColumn(
        "uncertain", F.lit(True)
    )
    return (
        catalog.withColumn("low", F.lower("token"))
        .join(pages, ["platform", "data_type"], "left")
        .join(doubt, "low", "left")
        .withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))
        .drop("low")
    )


def token_types(catalog: DataFrame) -> DataFrame:
    """(platform, token, types): lower-cased token to its set of types."""
    return catalog.groupBy("platform", F.lower("token").alias("token")).agg(
        F.array_sort(F.collect_set("data_type")).alias("types")
    )


def substrings(token: Column) -> Column:
    """All proper substrings of a token, whose length is bounded by that of an API name."""
    n = F.length(token)
    return F.array_except(
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), n),
                    lambda i: F.transform(
                        F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(token, i, k)
                    ),
                )
            )
        ),
        F.array(token),
    )


def contained_pairs(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(platform, short, short_types, long, long_types) where ``short`` is part of ``long``.

    Equality join on the substrings of the longer token instead of comparing all pairs.
    """
    parts = longer.select(
        "platform",
        F.col("token").alias("long"),
        F.col("types").alias("long_types"),
        F.explode(substrings(F.col("token"))).alias("short"),
    )
    small = shorter.select(
        "platform", F.col("token").alias("short"), F.col("types").alias("short_types")
    )
    return parts.join(small, ["platform", "short"])


def catalog_collisions(catalog: DataFrame) -> DataFrame:
    """Substring pairs whose types differ, per platform."""
    types = token_types(catalog)
    pairs = contained_pairs(types, types).filter(F.col("short_types") != F.col("long_types"))
    return pairs.groupBy("platform").agg(F.count("*").alias("n_pairs"))


def catalog_gaps(catalog: DataFrame) -> DataFrame:
    """(platform, data_type) without any API, from the fixed grid of both vocabularies."""
    grid = catalog.select("platform").distinct().select(
        "platform", F.explode(F.array(*[F.lit(t) for t in vocab.PERSONAL_TYPES])).alias("data_type")
    )
    return grid.join(catalog.select("platform", "data_type").distinct(), ["platform", "data_type"], "left_anti")


def catalog_stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("platform").agg(
        F.count("*").alias("entries"), F.countDistinct("data_type").alias("types")
    )


def merge_catalog(
    base: DataFrame, candidates: DataFrame, uncertain: DataFrame | None = None
) -> DataFrame:
    """Base plus accepted candidates with ``status`` base, added, excluded, existing or rejected.

    ``candidates`` carry ``rank``, the order of admission. A candidate that would contain, or be
    contained in, a token of other types is rejected. Admission is settled in rounds: a candidate
    is decided once no undecided one of lower rank conflicts with it, so each round decides at
    least the lowest of every conflict chain; the rounds end when nothing is pending.
    """
    low = F.lower("token")
    cand = candidates.withColumn("low", low)
    status = F.lit("pending")
    if uncertain is not None:
        doubt = uncertain.select(F.lower("token").alias("low")).distinct().withColumn("bad", F.lit(True))
        cand = cand.join(doubt, "low", "left")
        status = F.when(F.col("bad"), "excluded").otherwise(status)
    known = base.select("platform", "data_type", low.alias("low")).distinct().withColumn("old", F.lit(True))
    cand = cand.join(known, ["platform", "data_type", "low"], "left")
    cand = cand.withColumn(
        "status", F.when(F.col("old"), F.lit("existing")).otherwise(status)
    )
    if uncertain is not None:
        cand = cand.withColumn("status", F.when(F.col("bad"), "excluded").otherwise(F.col("status")))
    cand = cand.groupBy("platform", "data_type", "low").agg(
        F.min_by("token", "rank").alias("token"),
        F.min("rank").alias("rank"),
        F.min("status").alias("status"),
    )
    pending = cand.filter("status = 'pending'").select("platform", "low", "data_type", "rank", "token")
    settled = base.select("platform", low.alias("low"), "data_type")
    decided = None
    while not pending.isEmpty():
        now = cut_lineage(_one_round(settled, pending))
        done = now.filter("verdict is not null")
        decided = done if decided is None else decided.unionByName(done)
        settled = settled.unionByName(
            done.filter("verdict = 'added'").select("platform", "low", "data_type")
        )
        pending = now.filter("verdict is null").drop("verdict")
    rest = cand.filter("status <> 'pending'").select("platform", "data_type", "token", "status")
    out = base.select("platform", "data_type", "token", F.lit("base").alias("status")).unionByName(rest)
    if decided is None:
        return out
    return out.unionByName(
        decided.select("platform", "data_type", "token", F.col("verdict").alias("status"))
    )


def _one_round(settled: DataFrame, pending: DataFrame) -> DataFrame:
    """Decide the pending candidates that no earlier pending one can still influence."""
    own = settled.groupBy("platform", "low").agg(F.collect_set("data_type").alias("own_types"))
    pend = pending.join(own, ["platform", "low"], "left").withColumn(
        "types",
        F.array_sort(
            F.array_distinct(
                F.concat(
                    F.coalesce("own_types", F.array().cast("array<string>")), F.array("data_type")
                )
            )
        ),
    )
    fixed = settled.groupBy("platform", F.col("low").alias("token")).agg(
        F.array_sort(F.collect_set("data_type")).alias("types")
    )
    mine = pend.select(
        "platform", F.col("low").alias("token"), F.struct("rank", "types").alias("types")
    )
    wrapped = fixed.select(
        "platform", "token", F.struct(F.lit(-1).cast("bigint").alias("rank"), "types").alias("types")
    )
    pool = wrapped.unionByName(mine.withColumn("types", F.struct(F.col("types.rank").cast("bigint").alias("rank"), F.col("types.types").alias("types"))))
    pairs = contained_pairs(pool, pool)
    links = pairs.select(
        "platform", F.col("short").alias("low"), F.col("short_types").alias("me"), F.col("long_types").alias("other")
    ).unionByName(
        pairs.select(
            "platform", F.col("long").alias("low"), F.col("long_types").alias("me"), F.col("short_types").alias("other")
        )
    )
    same = mine.select(
        "platform",
        F.col("token").alias("low"),
        F.struct(F.col("types.rank").cast("bigint").alias("rank"), F.col("types.types").alias("types")).alias("me"),
    )
    twin = same.alias("a").join(same.alias("b"), ["platform", "low"]).filter("b.me.rank < a.me.rank")
    blocked_twin = twin.select(
        "platform", "low", F.col("a.me").alias("me"), F.lit(False).alias("clash"), F.lit(True).alias("waits")
    )
    facts = links.filter("me.rank >= 0").select(
        "platform",
        "low",
        "me",
        ((F.col("other.rank") < 0) & (F.col("other.types") != F.col("me.types"))).alias("clash"),
        ((F.col("other.rank") >= 0) & (F.col("other.rank") < F.col("me.rank"))).alias("waits"),
    )
    facts = facts.unionByName(blocked_twin).groupBy("platform", "low", F.col("me.rank").alias("rank")).agg(
        F.max("clash").alias("clash"), F.max("waits").alias("waits")
    )
    return pending.join(
        facts.withColumn("rank", F.col("rank").cast(pending.schema["rank"].dataType)),
        ["platform", "low", "rank"],
        "left",
    ).select(
        *pending.columns,
        F.when(F.col("clash"), "rejected")
        .when(F.col("waits"), F.lit(None).cast("string"))
        .otherwise("added")
        .alias("verdict"),
    )
