"""Rules where they are sure, the model elsewhere, review where either doubts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.config import AuditConfig
from callwarden.functions import calls
from callwarden.operators import scan
from callwarden.plans.classify import classify_calls


def agreement(rules_combo: Column, model_combo: Column, model_confidence: Column) -> Column:
    """The model, not unsure itself, contradicts what the rules settled on."""
    return (
        (rules_combo != "UNKNOWN||UNKNOWN")
        & (rules_combo != model_combo)
        & (model_confidence >= 0.5)
    )


def predict_hybrid(
    df: DataFrame,
    suggestions: DataFrame,
    cfg: AuditConfig | None = None,
    threshold: float = 0.85,
    calibrated: bool = True,
) -> DataFrame:
    """One result per call from rules and ``suggestions`` (id, model_combo, model_confidence,
    model_margin)."""
    columns = ["id", "model_combo", "model_confidence", "model_margin"]
    out = classify_calls(scan.input_guard(df), cfg).join(suggestions.select(*columns), "id", "left")
    stopped = F.col("guard_action") == "review"
    rules = ~stopped & (F.col("confidence") >= 0.9) & ~F.col("needs_review")
    low = F.coalesce(
        (F.col("model_confidence") < threshold) | (F.col("model_margin") < 0.1), F.lit(True)
    )
    clash = agreement(F.col("combo"), F.col("model_combo"), F.col("model_confidence"))
    label = f"model_conf<{threshold}_or_margin<0.1" + ("" if calibrated else "(uncalibrated)")
    reasons = F.concat_ws(
        ";",
        F.when(low, label),
        F.when(clash, F.concat(F.lit("rules_model_conflict(rules="), F.col("combo"), F.lit(")"))),
        F.when(F.col("needs_review"), F.col("review_reason")),
    )
    model = calls.split_combo(F.coalesce("model_combo", F.lit("UNKNOWN||UNKNOWN")))
    choose = lambda a, b: F.when(rules, a).when(~stopped, b)
    doubt = low | F.coalesce(clash, F.lit(False)) | F.col("needs_review")
    return out.select(
        "id",
        "text",
        "guard_action",
        choose(F.col("data_type"), model["data_type"]).alias("data_type"),
        choose(F.col("violation"), model["violation"]).alias("violation"),
        F.when(stopped, "UNKNOWN||UNKNOWN")
        .when(rules, F.col("combo"))
        .otherwise(F.coalesce("model_combo", F.lit("UNKNOWN||UNKNOWN")))
        .alias("combo"),
        F.when(stopped, 0.0)
        .when(rules, F.col("confidence"))
        .otherwise(F.coalesce("model_confidence", F.lit(0.0)))
        .alias("confidence"),
        F.when(stopped, "input_guard").when(rules, "rules").otherwise("model").alias("source"),
        (stopped | (~rules & doubt)).alias("needs_review"),
        F.when(
            stopped, F.concat(F.lit("upstream_residual:"), F.array_join("residual", ","))
        )
        .when(~rules & doubt, reasons)
        .alias("review_reason"),
    )
