"""Threshold calibration and strict certificate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden import vocab


def wall(alpha: Column) -> Column:
    """Violations needed for a finite-sample guarantee at ``alpha``; NULL if not computable."""
    inverse = F.lit(1.0) / alpha
    usable = ~F.isnan(alpha) & (alpha > 0) & (alpha <= 1) & (inverse <= 1e18)
    return F.when(usable, F.ceil(inverse) - 1)


#: Ranges that [0, 1] is cut into for the running sums; any number gives the same result.
RANGES = 1024


def score_steps(df: DataFrame, *by: str) -> DataFrame:
    """Per group and exact confidence: calls, violations, misses at that confidence.

    A miss is an automatic COMPLIANT on a true violation.
    """
    bad = F.col("true_violation") != "COMPLIANT"
    return df.groupBy(*by, F.col("confidence").alias("lam")).agg(
        F.count("*").alias("n"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(bad & (F.col("violation") == "COMPLIANT")).alias("n_miss"),
    )


def cumulative(steps: DataFrame, *by: str) -> DataFrame:
    """Automatic calls and misses at each threshold.

    Sums of ranges of confidence come first, at most ``RANGES`` + 1 rows a group; running sums
    then stay within one range, however many confidences a group has.
    """
    steps = steps.withColumn("range", F.floor(F.col("lam") * RANGES))
    ranges = steps.groupBy(*by, "range").agg(
        F.sum("n").alias("r_n"), F.sum("n_miss").alias("r_miss"), F.sum("n_bad").alias("r_bad")
    )
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = ranges.select(
        *[F.col(c).alias(f"r_{c}") for c in by],
        F.col("range").alias("r_range"),
        F.coalesce(F.sum("r_n").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("r_miss").over(above), F.lit(0)).alias("miss_above"),
        F.sum("r_n").over(whole).alias("n_all"),
        F.sum("r_bad").over(whole).alias("n_bad_all"),
    )
    same = F.col("range").eqNullSafe(F.col("r_range"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    upward = Window.partitionBy(*by, "range").orderBy(F.desc("lam")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(ranges, same).select(
        *by,
        "lam",
        (F.sum("n").over(upward) + F.col("n_above")).alias("n_auto"),
        (F.sum("n_miss").over(upward) + F.col("miss_above")).alias("n_miss"),
        "n_all",
        "n_bad_all",
    )


def crc_lambdas(df: DataFrame, *by: str, alphas: list[float], bound: float = 1.0) -> DataFrame:
    """Smallest threshold whose conformal bound on the miss rate stays within each ``alpha``.

    The bound is n/(n+1) * risk + B/(n+1) over true violations; NULL when even the highest
    observed confidence is too risky. The calls are read once for all levels.
    """
    table = cumulative(score_steps(df, *by), *by)
    table = table.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    n = F.col("n_bad_all")
    risk = F.when(n > 0, F.col("n_miss") / n).otherwise(0.0)
    limit = n / (n + 1) * risk + F.lit(bound) / (n + 1)
    return table.groupBy(*by, "alpha").agg(
        F.max("n_all").alias("n"),
        F.max("n_bad_all").alias("n_violation"),
        F.min(F.when(limit <= F.col("alpha"), F.col("lam"))).alias("lambda_hat"),
    )


def crc_lambda(df: DataFrame, *by: str, alpha: float = vocab.ALPHA_TARGET, bound: float = 1.0) -> DataFrame:
    """:func:`crc_lambdas` at one level."""
    return crc_lambdas(df, *by, alphas=[alpha], bound=bound).drop("alpha")


def lambda_for_budget(df: DataFrame, budget: float, *by: str) -> DataFrame:
    """Largest threshold whose review rate stays within ``budget``."""
    table = cumulative(score_steps(df, *by), *by)
    review = 1 - F.col("n_auto") / F.col("n_all")
    return table.groupBy(*by).agg(
        F.max(F.when(review <= budget, F.col("lam"))).alias("lambda_budget")
    )


def certification_columns(
    groups: DataFrame, alpha: float = vocab.ALPHA_TARGET, delta: float = 0.05, mu: str = "mu"
) -> DataFrame:
    """Sizes and bounds per group row with base risk ``mu``."""
    a = F.lit(float(alpha))
    return groups.withColumns(
        {
            "n_required": wall(a),
            "n_pac": F.ceil(F.log(1 / F.lit(float(delta))) / (2 * a * a)),
            "abstain_at_least": F.greatest(F.lit(0.0), (F.col(mu) - a) / (1 - a)),
        }
    )


def group_certification(df: DataFrame, *by: str, alpha: float = vocab.ALPHA_TARGET) -> DataFrame:
    """True violations per group against the number a grouped guarantee needs."""
    bad = F.count_if(F.col("true_violation") != "COMPLIANT")
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n"), bad.alias("n_violation"))
        .withColumn("n_required", wall(F.lit(float(alpha))))
        .withColumn("certifiable", F.col("n_violation") >= F.col("n_required"))
    )


def certificate_verdict(certs: DataFrame, column: str = "certificate") -> DataFrame:
    """Add ``certified`` and ``verdict``: strict check of certificate documents.

    A wrong type never passes for an absent field, and the inequality is recomputed here
    instead of trusting the flag in the document.
    """
    df = certs.withColumn("_v", F.try_parse_json(column))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    number = lambda k: F.try_variant_get("_v", f"$.{k}", "double")
    df = df.withColumns(
        {
            "_root": F.schema_of_variant("_v"),
            "_gk": kind("guarantee"),
            "_g": F.try_variant_get("_v", "$.guarantee", "boolean"),
            "_ak": kind("alpha"),
            "_a": number("alpha"),
            "_vk": kind("n_violation"),
            "_nv": number("n_violation"),
            "_nk": kind("n"),
            "_n": number("n"),
        }
    )
    numeric = F.col("_ak").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("_ak").startswith("DECIMAL")
    n_min = wall(F.col("_a"))
    verdict = (
        F.when(F.col(column).isNull(), "no_calibration")
        .when(~F.coalesce(F.col("_root").startswith("OBJECT"), F.lit(False)), "no_calibration")
        .when(
            ~F.coalesce((F.col("_gk") == "BOOLEAN") & F.col("_g"), F.lit(False)),
            "guarantee_not_strict_true",
        )
        .when(~F.coalesce(numeric, F.lit(False)), "alpha_not_numeric")
        .when(F.isnan("_a") | (F.col("_a") <= 0), "alpha_missing_or_invalid")
        .when(F.col("_a") > vocab.ALPHA_TARGET + 1e-12, "alpha_looser_than_target")
        .when(F.col("_vk").isNull(), "n_violation_missing")
        .when(F.col("_vk") != "BIGINT", "n_violation_wrong_type")
        .when(F.col("_nv") < 0, "n_violation_negative")
        .when(F.col("_nk").isNotNull() & (F.col("_nk") != "BIGINT"), "n_wrong_type")
        .when(F.col("_n") < 0, "n_negative")
        .when(F.col("_nv") > F.col("_n"), "n_violation_exceeds_n")
        .when(n_min.isNull(), "alpha_not_computable")
        .when(F.col("_nv") < n_min, "n_violation_below_wall")
        .otherwise("ok")
    )
    df = df.withColumns({"verdict": verdict, "n_min_required": n_min})
    own = ["_v", "_root", "_gk", "_g", "_ak", "_a", "_vk", "_nv", "_nk", "_n"]
    return df.withColumn("certified", F.col("verdict") == "ok").drop(*own)


def calibrate(df: DataFrame, *by: str, alpha: float = vocab.ALPHA_TARGET) -> DataFrame:
    """One certificate document per group, checked by the same strict verdict."""
    fitted = crc_lambda(df, *by, alpha=alpha).withColumn("n_required", wall(F.lit(float(alpha))))
    document = F.to_json(
        F.struct(
            ((F.col("n_violation") >= F.col("n_required")) & F.col("lambda_hat").isNotNull()).alias(
                "guarantee"
            ),
            F.lit(float(alpha)).alias("alpha"),
            "n",
            "n_violation",
            F.col("lambda_hat").alias("lambda_auto"),
        )
    )
    return certificate_verdict(fitted.withColumn("certificate", document))
