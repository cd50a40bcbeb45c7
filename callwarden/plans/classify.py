"""Verdict of the rules for every call.

One row-local pass (no exchange) identifies the type, reads the signals and walks the gates.
Only revocation looks across calls; it joins detections back by declaration shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.config import AuditConfig
from callwarden.functions import calls, policy, signals
from callwarden.functions.consts import known, per_session
from callwarden.operators import bayes, evidence, gates, identify, revocation
from callwarden.operators.staging import seal

TIERS = ["full", "none_verified", "class", "method", "payload", "consent", *vocab.INDIRECT_TIERS]


@per_session
def _segment_columns() -> tuple[Column, Column]:
    return calls.platform_effective(F.col("text")), calls.segments(F.col("text"))


def with_segments(df: DataFrame) -> DataFrame:
    """Add ``platform``, ``stack`` and ``body``."""
    platform, cut = _segment_columns()
    df = df.withColumns({"platform": platform, "_seg": cut})
    return df.withColumns({"stack": F.col("_seg.stack"), "body": F.col("_seg.body")}).drop("_seg")


@per_session
def _policy_verdict() -> Column:
    return policy.decide_ex(F.col("data_type"), F.col("malformed"))


def with_lambda(tier: Column, cfg: AuditConfig) -> Column:
    """Threshold in force for the tier of each call."""
    value = F.when(F.lit(False), F.lit(0.0))
    for name in dict.fromkeys(TIERS):
        value = value.when(tier == name, F.lit(float(cfg.effective_lambda(name))))
    return value.otherwise(F.lit(float(cfg.effective_lambda(None))))


def _typed_outcome(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Confidence, reasons and review flag of calls whose type is known."""
    tier, violation = F.col("tier"), F.col("verdict.violation")
    partial = tier.isin("class", "class_ambiguous", "method", "method_ambiguous")
    indirect = tier.isin("payload", "consent")
    if cfg.indirect_autopass:
        indirect = indirect & (violation == "COMPLIANT")
    unsure = (violation == "COMPLIANT") & (tier != "full")
    listed = F.array_contains("sig.consent_scope", F.col("data_type"))
    parsed_list = F.col("raw.consent_scope").isNotNull() & F.schema_of_variant(
        "raw.consent_scope"
    ).startswith("ARRAY")
    contradiction = (
        F.lit(cfg.scope_contract)
        & (violation == "COMPLIANT")
        & F.coalesce(parsed_list & ~listed, F.lit(False))
    )
    lacks = lambda *keys: ~F.arrays_overlap("present", F.array(*[F.lit(k) for k in keys]))
    df = df.withColumns(
        {
            "capped": partial | indirect | unsure | contradiction,
            "contradiction": contradiction,
            "reasons": known(
                F.when(partial, F.lit("partial_identifier")),
                F.when(indirect, F.concat(F.lit("indirect_tier:"), tier)),
                F.when(unsure, F.concat(F.lit("indirect_tier_compliant:"), tier)),
                F.when(contradiction, F.lit("contract_scope_contradiction")),
                F.when(lacks("consent_state", "consent_log"), F.lit("no_consent_evidence")),
                F.when(lacks("crypto", "transport"), F.lit("no_transport_info")),
                F.when(lacks("pii_mask"), F.lit("no_mask_info")),
            ),
            "rule_confidence": policy.rule_confidence(),
        }
    )
    blocked = (
        F.when(~F.col("parsed_ok"), "params_unparseable")
        .when(
            F.size("malformed") > 0,
            F.concat(
                F.lit("signal_type_malformed:"), F.array_join(F.slice("malformed", 1, 4), ",")
            ),
        )
        .when(violation.isNull(), F.col("verdict.bounds.reason"))
    )
    capped = F.when(F.col("capped"), F.least("rule_confidence", F.lit(0.85))).otherwise(
        F.col("rule_confidence")
    )
    return df.withColumns(
        {"blocked": blocked, "typed_confidence": F.when(blocked.isNull(), capped).otherwise(0.0)}
    )


SEGMENTS = ("platform", "stack", "body")
SIGNALS = ("object_keys", "raw", "salvaged", "present", "parsed_ok", "sig", "malformed")


def _as_unread(df: DataFrame, small: Column) -> DataFrame:
    """Segments and signals at hand as those of no text where the call isn't ``small``."""
    nothing, small = F.array().cast("array<string>"), F.coalesce(small, F.lit(False))
    other = {"body": F.lit(""), "present": nothing, "malformed": nothing, "parsed_ok": F.lit(False)}
    return df.withColumns({c: F.when(small, F.col(c)).otherwise(other.get(c, F.lit(None))) for c in (*SEGMENTS, *SIGNALS)})


def row_verdicts(df: DataFrame, cfg: AuditConfig, ready: bool = False) -> DataFrame:
    """Everything that depends on the call alone; keeps the columns of ``df``.

    The text of an oversized call is set aside first, so no pattern ever runs over it. A ``ready`` table
    brings the columns ``SEGMENTS`` and ``SIGNALS`` along.
    """
    keep = df.columns
    df = df.withColumn("_whole", F.col("text"))
    small = F.length("_whole") <= cfg.max_text_chars
    df = df.withColumn("text", F.when(small, F.col("_whole")))
    df = _as_unread(df, small) if ready else with_segments(df)
    df = identify.identify(df, cfg.catalog)
    if not ready:
        df = signals.normalize_signals(signals.parse_signals(df))
    if "guard_type" not in df.columns:
        opinion = bayes.guard_type(df.sparkSession, cfg.guard) if cfg.guard else F.lit(None).cast("string")
        df = df.withColumn("guard_type", opinion)
    df = gates.gate_flags(df, cfg)
    df = evidence.with_evidence(df, needed=F.col("at_empty_gate"))
    df = df.withColumn("verdict", _policy_verdict())
    df = _typed_outcome(df, cfg)
    df = df.withColumns(
        {
            "gate_reason": F.when(F.col("data_type").isNull(), gates.none_gate_reason(cfg)),
            "oversized": F.coalesce(F.length("_whole") > cfg.max_text_chars, F.lit(False)),
        }
    )
    passes = F.col("data_type").isNull() & F.col("gate_reason").isNull()
    df = df.withColumns(
        {
            "final_tier": F.when(passes, "none_verified").otherwise(F.col("tier")),
            "final_type": F.when(passes, "NONE").otherwise(F.col("data_type")),
            "final_violation": F.when(passes, "COMPLIANT").when(
                F.col("data_type").isNotNull() & F.col("parsed_ok"), F.col("verdict.violation")
            ),
            "final_confidence": F.when(passes, 0.9)
            .when(F.col("data_type").isNotNull(), F.col("typed_confidence"))
            .otherwise(0.0),
        }
    )
    df = df.withColumn("lambda", with_lambda(F.col("final_tier"), cfg))
    below = F.col("final_confidence") < F.col("lambda")
    reason = F.coalesce(
        F.when(F.col("data_type").isNull(), F.col("gate_reason")).otherwise(F.col("blocked")),
        F.when(passes & below, "none_verified_below_lambda"),
        F.when(~passes & below, F.array_join("reasons", ",")),
    )
    untyped_stop = F.col("data_type").isNull() & F.col("gate_reason").isNotNull()
    df = df.withColumns(
        {
            "needs_review": F.when(F.col("data_type").isNull(), untyped_stop | below).otherwise(
                F.col("blocked").isNotNull() | below
            ),
            "review_reason": reason,
        }
    )
    verdict = {
        "data_type": F.when(~F.col("oversized"), F.col("final_type")),
        "violation": F.when(~F.col("oversized"), F.col("final_violation")),
        "confidence": F.when(F.col("oversized"), 0.0).otherwise(F.col("final_confidence")),
        "tier": F.when(~F.col("oversized"), F.col("final_tier")),
        "needs_review": F.col("oversized") | F.col("needs_review"),
        "review_reason": F.when(F.col("oversized"), "input_oversized").otherwise(
            F.col("review_reason")
        ),
        "bounds": F.when(
            F.col("data_type").isNotNull() & F.col("parsed_ok"), F.col("verdict.bounds")
        ),
        "auto_lambda": F.col("lambda"),
        "fingerprint": F.col("fingerprint"),
        "at_empty_gate": F.coalesce("at_empty_gate", F.lit(False)),
        "detected": F.coalesce(F.size("value_shapes") > 0, F.lit(False))
        | (F.col("data_type").isNotNull() & F.coalesce("contradiction", F.lit(False))),
    }
    kept = [F.col("_whole").alias(c) if c == "text" else c for c in keep if c not in verdict]
    df = df.select(*kept, *[c.alias(n) for n, c in verdict.items()])
    # these are left to the optimizer, which drops them where nobody reads them
    return seal(df, *[c for c in verdict if c not in ("bounds", "auto_lambda", "fingerprint")])


def classify_calls(
    df: DataFrame,
    cfg: AuditConfig | None = None,
    order: list[str] | None = None,
    revoked: DataFrame | None = None,
    ready: bool = False,
) -> DataFrame:
    """Rule verdict of every call (columns of ``df`` plus the verdict).

    With an audit key, or a table of stored revocations, a declaration shape that was caught
    earlier in ``order`` sends all its later empty declarations to review. ``ready`` as for :func:`row_verdicts`.
    """
    cfg = cfg or AuditConfig()
    return settle(row_verdicts(df, cfg, ready), cfg, order, revoked)


def settle(out: DataFrame, cfg: AuditConfig, order: list[str] | None = None, revoked: DataFrame | None = None) -> DataFrame:
    """Row verdicts with what other calls revoke, and ``combo``; with revocation they are read twice."""
    order = order or ["id"]
    if cfg.audit_key or revoked is not None:
        out = out.withColumn("pos", F.struct(*order))
        detected = F.col("detected") if cfg.audit_key else F.lit(False)
        first = revocation.first_detections(out, detected)
        out = revocation.mark_revoked(out, first, revoked, salts=cfg.salts).drop("pos")
        hit = F.col("is_revoked") & F.col("at_empty_gate")
        out = out.withColumns(
            {
                "data_type": F.when(~hit, F.col("data_type")),
                "violation": F.when(~hit, F.col("violation")),
                "confidence": F.when(hit, 0.0).otherwise(F.col("confidence")),
                "tier": F.when(hit, "none").otherwise(F.col("tier")),
                "review_reason": F.when(hit, "scope_declaration_revoked").otherwise(
                    F.col("review_reason")
                ),
                "needs_review": hit | F.col("needs_review"),
                "bounds": F.when(~hit, F.col("bounds")),
                "auto_lambda": F.when(~hit, F.col("auto_lambda")),
            }
        ).drop("is_revoked")
    combo = F.when(F.col("data_type").isNull(), "UNKNOWN||UNKNOWN").otherwise(
        F.concat_ws("||", "data_type", F.coalesce("violation", F.lit("UNKNOWN")))
    )
    return out.withColumn("combo", combo)
