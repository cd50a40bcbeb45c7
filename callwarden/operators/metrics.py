"""Aggregates over verdicts and truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.functions.calls import severity


def share(part: Column, whole: Column) -> Column:
    """Ratio that is NULL on an empty base."""
    return F.when(whole > 0, part / whole)


def truth_join(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions with their truth label ``true_violation``."""
    return decisions.join(truth.select("id", "true_violation"), "id")


def with_outcome(df: DataFrame) -> DataFrame:
    """Add ``path``: what happened to each call; ``unlabelled`` where no truth is known."""
    auto, pred = ~F.col("needs_review"), F.col("violation")
    bad = F.col("true_violation") != "COMPLIANT"
    return df.withColumn(
        "path",
        F.when(F.col("true_violation").isNull(), "unlabelled")
        .when(~auto, F.when(bad, "violation_reviewed").otherwise("compliant_reviewed"))
        .when(bad & pred.isNull(), "violation_undecided")
        .when(bad & (pred == "COMPLIANT"), "violation_missed")
        .when(bad & (severity(pred) > severity(F.col("true_violation"))), "violation_downgraded")
        .when(bad, "violation_caught")
        .when(pred == "COMPLIANT", "compliant_passed")
        .otherwise("compliant_alarmed"),
    )


def leak_report(df: DataFrame, *by: str) -> DataFrame:
    """One pass over labelled verdicts: rates of leaks, false alarms and downgrades."""
    df = with_outcome(df)
    n, bad = F.count("*"), F.count_if(F.col("true_violation") != "COMPLIANT")
    at = lambda *names: F.count_if(F.col("path").isin(*names))
    grouped = df.groupBy(*by)
    return grouped.agg(
        n.alias("n"),
        share(F.count_if(~F.col("needs_review")), n).alias("auto_rate"),
        share(F.count_if("needs_review"), n).alias("review_rate"),
        bad.alias("n_violation"),
        (n - bad).alias("n_compliant"),
        share(at("violation_missed"), bad).alias("miss_rate"),
        share(at("compliant_alarmed"), n - bad).alias("false_alarm_rate"),
        share(at("violation_downgraded"), bad).alias("downgrade_rate"),
        at("violation_undecided").alias("n_auto_undecided"),
        at("violation_missed").alias("n_missed"),
        at("violation_caught", "violation_downgraded").alias("n_caught"),
        at("violation_reviewed").alias("n_violation_reviewed"),
    )


def leak_examples(df: DataFrame, k: int = 5, clip: int = 160) -> DataFrame:
    """First ``k`` leaks and downgrades by id, text clipped; one pass, and each task sends ``k`` of a path at most."""
    hits = with_outcome(df).filter(F.col("path").isin("violation_missed", "violation_downgraded"))
    hits = hits.select("path", "id", "true_violation", "violation", F.substring("text", 1, clip).alias("text"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def run_totals(df: DataFrame) -> DataFrame:
    """Calls, human reviews and their share."""
    human = F.count_if("needs_review")
    return df.agg(
        F.count("*").alias("n"), human.alias("n_human"), share(human, F.count("*")).alias("human_rate")
    )


def class_balance(df: DataFrame, combo: str = "combo") -> DataFrame:
    """Per-class counts with the spread over declared classes."""
    counts = df.groupBy(F.col(combo).alias("combo")).agg(F.count("*").alias("n"))
    spread = counts.agg(
        F.count("*").alias("classes_seen"), F.min("n").alias("n_min"), F.max("n").alias("n_max")
    )
    return counts.join(F.broadcast(spread)).withColumn(
        "classes_declared", F.lit(len(vocab.combos())).cast("bigint")
    )


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    labels = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(truth).alias("label")),
                               F.struct(F.lit(1).alias("side"), F.col(pred).alias("label"))))
    hit = (F.col(truth) == F.col(pred)).alias("hit")
    per = (
        df.select(labels.alias("s"), hit)
        .groupBy(F.col("s.label").alias("label"))
        .agg(
            F.count_if(F.col("s.side") == 0).alias("support"),
            F.count_if(F.col("s.side") == 1).alias("predicted"),
            F.count_if((F.col("s.side") == 0) & F.col("hit")).alias("correct"),
        )
    )
    zero = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    per = per.select(
        "label",
        zero(F.col("correct"), F.col("predicted")).alias("precision"),
        zero(F.col("correct"), F.col("support")).alias("recall"),
        zero(2 * F.col("correct"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "correct",
    )
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    total = F.sum("support")
    summary = per.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                (F.sum("correct") / total).alias("precision"),
                (F.sum("correct") / total).alias("recall"),
                (F.sum("correct") / total).alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                total.alias("support"),
            ),
        ).alias("s")
    ).select(F.inline("s"))
    return per.drop("correct").unionByName(summary)


def guard_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Exact-type accuracy and sensitive-or-not accuracy."""
    t, p = F.col(truth), F.col(pred)
    return df.agg(
        F.count("*").alias("n"),
        F.avg((t == p).cast("double")).alias("type_accuracy"),
        F.avg(((t != "NONE") == (p != "NONE")).cast("double")).alias("sensitive_accuracy"),
    )


def conflict_rate(df: DataFrame, *by: str) -> DataFrame:
    """Share of verdicts whose reasons contain a self-contradicting declaration."""
    hit = F.coalesce(F.col("review_reason").contains("contract_scope_contradiction"), F.lit(False))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("n_conflict"),
        (F.count_if(hit) / F.count("*")).alias("conflict_share"),
    )


def redline_breaches(df: DataFrame) -> DataFrame:
    """Unreviewed COMPLIANT verdicts outside the two tiers that may give one; must be empty."""
    return df.filter(
        ~F.col("needs_review")
        & (F.col("violation") == "COMPLIANT")
        & ~F.col("tier").isin("full", "none_verified")
    )


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Most frequent keys; ties by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)
