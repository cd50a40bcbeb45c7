"""Named tables of the measurement and of the event report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callwarden.config import AuditConfig
from callwarden.operators import events, metrics
from callwarden.plans.classify import classify_calls


def measure(labelled: DataFrame, cfg: AuditConfig | None = None) -> dict[str, DataFrame]:
    """Leak report and examples of classifying labelled calls."""
    verdicts = classify_calls(labelled, cfg)
    return {"report": metrics.leak_report(verdicts), "examples": metrics.leak_examples(verdicts)}


def summarize_events(log: DataFrame, top: int = 25) -> dict[str, DataFrame]:
    """Every section of the event report as its own DataFrame."""
    samples = log.filter("ev = 'sample'")
    return {
        "overview": events.run_overview(log),
        "backends": events.backend_overview(log),
        "outcomes": events.outcome_distribution(samples),
        "review_reasons": events.review_reasons(samples, top),
        "api_outcomes": events.api_outcomes(samples, top),
        "tiers": events.tier_distribution(samples),
        "model_kinds": events.field_distribution(samples, "l3_kind"),
        "confidence": events.confidence_histogram(samples),
        "latency": events.stage_latency(samples),
        "errors": events.error_summary(log, top),
        "candidates": events.catalog_candidates(samples),
        "insights": events.insights(log),
    }
