"""Policy verdict as ``when`` chains over the normalised signals (column ``sig``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.functions.calls import BLANK
from callwarden.functions.consts import const


def s(key: str) -> Column:
    return F.col(f"sig.{key}")


def consent_valid(data_type: Column) -> Column:
    """True, False, or NULL when the evidence says neither."""
    state, log = s("consent_state"), s("consent_log")
    in_scope = F.coalesce(F.array_contains(s("consent_scope"), data_type), F.lit(False))
    expired = F.coalesce(s("consent_version_expired"), F.lit(False))
    logged = F.transform(
        F.split(F.regexp_replace(log, "^granted:", ""), ","),
        lambda t: F.btrim(t, F.lit(BLANK)),
    )
    return (
        F.when(state.isin(vocab.REFUSED_CONSENT), F.lit(False))
        .when(state == "granted", in_scope & ~expired)
        .when(state.isNotNull(), F.lit(None).cast("boolean"))
        .when(log.startswith("granted:"), F.array_contains(logged, data_type))
        .when(log.startswith("revoked"), F.lit(False))
    )


def purpose_allowed(data_type: Column, purpose: Column) -> Column:
    allowed = const(vocab.PURPOSES, "map<string,array<string>>")
    return F.coalesce(
        F.array_contains(F.try_element_at(allowed, data_type), purpose), F.lit(False)
    )


def metadata_unobservable() -> Column:
    """No consent, transport or masking evidence at all."""
    keys = ["consent_state", "consent_log", "consent_scope", "crypto", "transport", "pii_mask"]
    gone = F.lit(True)
    for key in keys:
        gone = gone & s(key).isNull()
    return gone


def decide(data_type: Column) -> Column:
    """First violated rule, in order of severity; the signals must be well formed."""
    undisclosed = (s("policy_disclosed") == F.lit(False)) | (
        s("policy_updated_after_consent") == F.lit(True)
    )
    plaintext = s("crypto").isin(vocab.BAD_CRYPTO) | (s("transport") == "http")
    unmasked = (s("pii_mask") == "raw") | (
        (s("pii_mask") == "partial") & data_type.isin(vocab.HIGH_SENSITIVITY)
    )
    excessive = (
        (s("biz_purpose").isNotNull() & ~purpose_allowed(data_type, s("biz_purpose")))
        | (s("collect_scope") == "all")
        | (s("extra_fields_collected") == F.lit(True))
    )
    soft = (
        (s("data_destination") == "third_party") & (s("separate_consent") == F.lit(False))
    ) | (s("retention_days") > vocab.RETENTION_WARN_DAYS)
    return (
        F.when(data_type == "NONE", "COMPLIANT")
        .when(~F.coalesce(consent_valid(data_type), F.lit(False)), "NO_CONSENT")
        .when(undisclosed, "NOT_DISCLOSED")
        .when(plaintext, "PLAINTEXT_TRANSMIT")
        .when(unmasked, "NO_MASK")
        .when(excessive, "OVER_COLLECT")
        .when(soft, "WARNING")
        .otherwise("COMPLIANT")
    )


BOUNDS_DDL = "struct<optimistic:string,pessimistic:string,reason:string>"


def decide_ex(data_type: Column, malformed: Column) -> Column:
    """Struct (violation, bounds): no verdict on malformed or unobservable evidence."""
    bad = F.size(malformed) > 0
    unobservable = (data_type != "NONE") & metadata_unobservable()
    bounds = F.struct(
        F.lit("COMPLIANT").alias("optimistic"),
        F.lit("NO_CONSENT").alias("pessimistic"),
        F.lit("compliance_metadata_unobservable").alias("reason"),
    )
    return F.struct(
        F.when(~bad & ~unobservable, decide(data_type)).alias("violation"),
        F.when(~bad & unobservable, bounds).alias("bounds"),
    )


def decide_conservative(verdict: Column) -> Column:
    """Verdict, else the pessimistic end."""
    return F.coalesce(verdict["violation"], verdict["bounds"]["pessimistic"], F.lit("NO_CONSENT"))


def rule_confidence() -> Column:
    """Confidence by the number of missing core signals: consent, transport, masking."""
    have = lambda *keys: F.arrays_overlap("present", F.array(*[F.lit(k) for k in keys]))
    missing = (
        F.when(have("consent_state", "consent_log"), 0).otherwise(1)
        + F.when(have("crypto", "transport"), 0).otherwise(1)
        + F.when(have("pii_mask"), 0).otherwise(1)
    )
    return F.when(missing == 0, 0.99).when(missing == 1, 0.80).otherwise(0.55)
