"""The whole funnel: input guard, rules, advice, external verdict, human queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.config import AuditConfig
from callwarden.functions import text
from callwarden.operators import restore, scan
from callwarden.plans.classify import classify_calls
from callwarden.session import cut_lineage

EXTERNAL_LABELS = [v for v in vocab.SEVERITY_ORDER if v != "COMPLIANT"]


def verdict_contract(verdicts: DataFrame) -> DataFrame:
    """External verdicts reduced to what may be trusted.

    Only a violation with a known label counts, and only at confidence 0.9 or more is it
    automatic. A missing confidence counts as none. COMPLIANT cannot be said from outside.
    """
    fits = (F.col("verdict") == "violation") & F.col("violation").isin(EXTERNAL_LABELS)
    fits = F.coalesce(fits, F.lit(False))
    return verdicts.select(
        "id",
        F.when(fits, "violation").otherwise("uncertain").alias("external_verdict"),
        F.when(fits, F.col("violation")).alias("external_violation"),
        F.when(fits, F.col("data_type")).alias("external_type"),
        (fits & (F.coalesce("confidence", F.lit(0.0)) >= 0.9)).alias("external_auto"),
    )


def guarded_text(df: DataFrame) -> DataFrame:
    """Add the guard's columns; texts with harmless residue are restored first.

    Only those rows are cut into tokens. They are found by one pass and kept on the shared folder; all
    others pass through unchanged, and without such rows the rest of the plan stays a single branch.
    """
    found = df.filter(text.residue_to_restore(F.col("text")))
    df = scan.input_guard(df)
    keep = df.columns
    dirty = cut_lineage(scan.input_guard(found))
    if dirty.isEmpty():
        return df
    restored = restore.restore_text(dirty)
    restored = restored.select(
        *[F.col("normalized").alias("text") if c == "text" else F.col(c) for c in keep]
    )
    return df.filter("guard_action <> 'preprocess'").unionByName(restored)


def run_funnel(
    df: DataFrame,
    cfg: AuditConfig | None = None,
    advice: DataFrame | None = None,
    external: DataFrame | None = None,
    restore_dirty: bool = True,
    order: list[str] | None = None,
) -> DataFrame:
    """Decision, layer, reason and trace for every call.

    ``advice`` (id, model_combo, model_confidence) is recorded and never decides; ``external``
    holds verdict rows under :func:`verdict_contract`.
    """
    df = guarded_text(df) if restore_dirty else scan.input_guard(df)
    out = classify_calls(df, cfg, order)
    if advice is None:
        out = out.withColumns(
            {
                "model_combo": F.lit(None).cast("string"),
                "model_confidence": F.lit(None).cast("double"),
            }
        )
    else:
        out = out.join(advice.select("id", "model_combo", "model_confidence"), "id", "left")
    if external is None:
        out = out.withColumns(
            {
                "external_verdict": F.lit(None).cast("string"),
                "external_violation": F.lit(None).cast("string"),
                "external_type": F.lit(None).cast("string"),
                "external_auto": F.lit(False),
            }
        )
    else:
        out = out.join(verdict_contract(external), "id", "left")
    stopped = F.col("guard_action") == "review"
    settled = ~stopped & ~F.col("needs_review") & F.col("violation").isNotNull()
    outside = ~stopped & ~settled & F.coalesce("external_auto", F.lit(False))
    reason = F.coalesce("review_reason", F.lit("rules_low_confidence"))
    trace = F.struct(
        F.col("guard_action").alias("l2_guard"),
        F.when(
            ~stopped,
            F.struct(F.col("combo"), F.col("confidence"), F.col("tier"), F.col("needs_review")),
        ).alias("l1"),
        F.when(
            ~stopped & ~settled & F.col("model_combo").isNotNull(),
            F.struct(
                F.col("model_combo").alias("suggest"),
                F.col("model_confidence").alias("confidence"),
                F.lit("model").alias("kind"),
            ),
        ).alias("l3"),
    )
    kept = [c for c in df.columns if c not in ("residual", "guard_action", "suspected_encrypted")]
    return out.select(
        *kept,
        F.when(settled, F.col("violation"))
        .when(outside, F.col("external_violation"))
        .alias("decision"),
        F.when(stopped, F.lit(None).cast("string"))
        .when(outside, F.col("external_type"))
        .otherwise(F.col("data_type"))
        .alias("data_type"),
        (~settled & ~outside).alias("needs_human"),
        F.when(settled, "rules").when(outside, "external").otherwise("human").alias("final_layer"),
        F.when(
            stopped, F.concat(F.lit("L2_input_residual:"), F.array_join("residual", ","))
        )
        .when(~settled, reason)
        .alias("review_reason"),
        trace.alias("trace"),
    )
