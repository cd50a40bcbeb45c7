"""Audit events and the tables of the event report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.functions import calls
from callwarden.operators.quantiles import exact_quantiles
from callwarden.operators.scan import scrub_text
from callwarden.session import cut_lineage

# --- fixed values: advice by reason prefix, in order -----------------------------------
REASON_HINTS = [
    ("contract_missing_consent_scope", "send consent_scope, an empty list for non-personal calls"),
    ("obfuscated_identifier_unresolved", "finish de-obfuscation upstream"),
    ("unknown_sensitive_api_hint", "add the API to the catalogue"),
    ("L2_input_residual", "remove residual encodings upstream"),
    ("ambiguous_partial_identifier", "send more stack context"),
    ("indirect_tier", "send the missing signals"),
    ("rules_low_confidence", "send the missing signals"),
    ("compliance_metadata_unobservable", "mark the reporting channel upstream"),
]
DEFAULT_HINT = "see the trigger of this reason"


def outcome(needs_human: Column, decision: Column) -> Column:
    return (
        F.when(needs_human, "REVIEW")
        .when(decision == "COMPLIANT", "AUTO_COMPLIANT")
        .when(decision.isNotNull(), "AUTO_VIOLATION")
        .otherwise("REVIEW")
    )


def decision_events(df: DataFrame, level: str = "safe", keep: tuple[str, ...] = ()) -> DataFrame:
    """Funnel results as audit ``sample`` events with a constant schema, and the columns ``keep`` beside it."""
    df = scrub_text(df, level=level)
    return df.select(
        F.lit("sample").alias("ev"),
        F.col("id").alias("sid"),
        calls.frame_api(F.col("text")).alias("api"),
        F.length("text").alias("text_len"),
        calls.input_digest(F.col("text")).alias("input_sha1"),
        F.col("safe_text").alias("text"),
        outcome(F.col("needs_human"), F.col("decision")).alias("outcome"),
        F.col("trace.l2_guard").alias("l2_guard"),
        F.col("trace.l1.combo").alias("l1_combo"),
        F.col("trace.l1.tier").alias("l1_tier"),
        F.col("trace.l1.confidence").alias("l1_confidence"),
        F.col("trace.l1.needs_review").alias("l1_needs_review"),
        F.col("trace.l3.kind").alias("l3_kind"),
        F.col("trace.l3.suggest").alias("l3_combo"),
        F.col("trace.l3.confidence").alias("l3_confidence"),
        "decision",
        "data_type",
        "needs_human",
        "final_layer",
        "review_reason",
        *keep,
    )


def hybrid_events(df: DataFrame, level: str = "safe") -> DataFrame:
    """Results of rules plus model in the same event shape, marked ``src = predict``."""
    df = scrub_text(df, level=level)
    return df.select(
        F.lit("sample").alias("ev"),
        F.lit("predict").alias("src"),
        F.col("id").alias("sid"),
        calls.frame_api(F.col("text")).alias("api"),
        F.length("text").alias("text_len"),
        calls.input_digest(F.col("text")).alias("input_sha1"),
        F.col("safe_text").alias("text"),
        outcome(F.col("needs_review"), F.col("violation")).alias("outcome"),
        F.col("guard_action").alias("l2_guard"),
        F.col("combo").alias("l3_combo"),
        F.col("confidence").alias("l3_confidence"),
        F.col("violation").alias("decision"),
        "data_type",
        F.col("needs_review").alias("needs_human"),
        F.col("source").alias("final_layer"),
        "review_reason",
    )


# --- report tables ------------------------------------------------------------------------
def norm_reason(reason: Column) -> Column:
    """Stable class of a reason: the part before its arguments."""
    head = F.btrim(F.get(F.split(reason, "[:;,]"), F.lit(0)))
    return (
        F.when(F.coalesce(reason, F.lit("")) == "", "(auto)")
        .when(head == "", "(empty)")
        .otherwise(head)
    )


def reason_hint(reason: Column) -> Column:
    hint = F.when(F.lit(False), F.lit(""))
    for prefix, text in REASON_HINTS:
        hint = hint.when(reason.startswith(prefix), F.lit(text))
    return hint.otherwise(DEFAULT_HINT)


def event_outcome() -> Column:
    """Recorded outcome, else what the review flag says."""
    return F.coalesce("outcome", F.when(F.col("needs_human"), "REVIEW").otherwise("?"))


def _share_of_total(counts: DataFrame) -> DataFrame:
    """Add ``share``; the total is one row, bounded by construction."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(
        *counts.columns, (F.col("n") / F.col("total")).alias("share")
    )


def outcome_distribution(samples: DataFrame) -> DataFrame:
    return _share_of_total(samples.groupBy(event_outcome().alias("outcome")).agg(F.count("*").alias("n")))


def outcome_rollup(samples: DataFrame, platform: str = "platform") -> DataFrame:
    """Outcomes by platform, by platform alone and in all, from one pass over the samples.

    ``level`` tells a total from a NULL platform: 0 a pair, 1 a platform, 3 all; ``share`` is the
    part of the row above (of the platform for a pair, of all samples for a platform).
    """
    rows = samples.select(F.col(platform).alias("platform"), event_outcome().alias("outcome"))
    table = rows.rollup("platform", "outcome").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    table = table.select("platform", "outcome", F.col("level").cast("int").alias("level"), "n")
    above = Window.partitionBy("up", "named")
    up = F.when(F.col("level") == 0, 1).when(F.col("level") == 1, 3).otherwise(7)
    table = table.withColumns({"up": up, "named": F.when(F.col("level") == 0, F.struct("platform"))})
    return table.select("platform", "outcome", "level", "n", (F.col("n") / F.sum("n").over(above)).alias("share"))


def review_reasons(samples: DataFrame, top: int = 25) -> DataFrame:
    """Most frequent review reasons with their share of reviews and advice."""
    reasons = (
        samples.filter("needs_human")
        .groupBy(norm_reason(F.col("review_reason")).alias("reason"))
        .agg(F.count("*").alias("n"))
    )
    ranked = _share_of_total(reasons).orderBy(F.desc("n"), "reason").limit(top)
    return ranked.withColumn("hint", reason_hint(F.col("reason")))


def api_outcomes(samples: DataFrame, top: int = 25) -> DataFrame:
    """Outcomes per API and the share of reviews."""
    n, api = F.count("*"), F.coalesce(F.nullif("api", F.lit("")), F.lit("(none)"))
    kind = event_outcome()
    table = samples.groupBy(api.alias("api")).agg(
        n.alias("n"),
        F.count_if(kind == "AUTO_COMPLIANT").alias("auto_compliant"),
        F.count_if(kind == "AUTO_VIOLATION").alias("auto_violation"),
        F.count_if(kind == "REVIEW").alias("review"),
        (F.count_if(kind == "REVIEW") / n).alias("review_share"),
    )
    return table.orderBy(F.desc("n"), "api").limit(top)


def tier_distribution(samples: DataFrame) -> DataFrame:
    counts = samples.filter("l1_tier is not null").groupBy("l1_tier").agg(F.count("*").alias("n"))
    return _share_of_total(counts)


def confidence_bin(c: Column) -> Column:
    return (
        F.when(c < 0.30, "<0.30")
        .when(c < 0.50, "0.30-0.50")
        .when(c < 0.70, "0.50-0.70")
        .when(c < 0.85, "0.70-0.85")
        .when(c < 0.95, "0.85-0.95")
        .otherwise(">=0.95")
    )


def confidence_histogram(samples: DataFrame, column: str = "l3_confidence") -> DataFrame:
    """Fixed bins beside the overall mean, median and share of high confidence.

    The confidences are read once; bins carry sums, so their six rows give the totals.
    """
    values = cut_lineage(samples.filter(F.col(column).isNotNull()).select(F.col(column).alias("c")))
    c = F.col("c")
    bins = values.groupBy(confidence_bin(c).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(c).alias("total"), F.count_if(c >= 0.85).alias("high")
    )
    total = bins.agg(
        F.sum("n").alias("n_all"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        (F.sum("high") / F.sum("n")).alias("share_high"),
    )
    median = exact_quantiles(values, [], "c", {"p50": 0.5})
    return bins.select("bin", "n").join(F.broadcast(total)).join(F.broadcast(median))


def stage_latency(samples: DataFrame) -> DataFrame:
    """Per stage: n, mean, nearest-rank p50 and p95, max of the timings map ``ms``.

    A stage without any timing has n = 0 and NULLs.
    """
    stages = cut_lineage(samples.select(F.explode("ms").alias("stage", "t")))
    means = stages.groupBy("stage").agg(F.count("t").alias("n"), F.avg("t").alias("mean"), F.max("t").alias("max"))
    ranks = exact_quantiles(stages, ["stage"], "t", {"p50": 0.5, "p95": 0.95})
    return means.join(ranks, "stage", "left").select("stage", "n", "mean", "p50", "p95", "max")


def error_summary(events: DataFrame, top: int = 25) -> DataFrame:
    table = (
        events.filter("ev = 'error'")
        .groupBy("stage", "err_type")
        .agg(F.count("*").alias("n"), F.min_by("err", "seq").alias("first_err"))
    )
    return table.orderBy(F.desc("n"), "stage", "err_type").limit(top)


def run_overview(events: DataFrame) -> DataFrame:
    """Counts by kind and the settings of the last run."""
    return events.agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("ev") == "sample").alias("n_samples"),
        F.count_if(F.col("ev") == "error").alias("n_errors"),
        F.count_if(F.col("_bad").isNotNull()).alias("n_bad"),
        F.max_by(
            F.when(F.col("ev") == "run_start", F.col("run")),
            F.when(F.col("ev") == "run_start", F.col("seq")),
        ).alias("last_run"),
    )


def backend_overview(events: DataFrame) -> DataFrame:
    """First event of each backend."""
    return (
        events.filter("ev = 'backend'")
        .groupBy("kind")
        .agg(F.min_by(F.struct("available", "note"), "seq").alias("first"))
        .select("kind", "first.available", "first.note")
    )


def field_distribution(df: DataFrame, key: str) -> DataFrame:
    """Counts of one field; nested values as JSON."""
    kind = df.schema[key].dataType.typeName()
    value = F.to_json(key) if kind in ("array", "map", "struct") else F.col(key).cast("string")
    return (
        df.filter(F.col(key).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    )


def catalog_candidates(samples: DataFrame, top: int = 8) -> DataFrame:
    """APIs the catalogue does not know, most frequent first."""
    missed = samples.filter("(l1_tier is null or l1_tier = 'none') and api is not null")
    table = missed.groupBy("api").agg(F.count("*").alias("n"))
    return table.orderBy(F.desc("n"), "api").limit(top)


def insights(events: DataFrame) -> DataFrame:
    """Advice rows derived from one pass over the events plus the top review reason."""
    samples = events.filter("ev = 'sample'")
    high = F.count_if(F.col("l3_confidence") >= 0.85) / F.count("l3_confidence")
    facts = events.agg(
        F.count_if(F.col("ev") == "sample").alias("samples"),
        F.count_if((F.col("ev") == "sample") & (event_outcome() == "AUTO_COMPLIANT")).alias("passed"),
        F.count_if(
            (F.col("ev") == "sample") & F.coalesce(F.col("l1_tier") == "none", F.lit(True))
        ).alias("unknown"),
        F.count_if(F.col("ev") == "error").alias("errors"),
        high.alias("high"),
    )
    tip = lambda name, n, on: F.struct(
        F.lit(name).alias("tip"), n.cast("bigint").alias("n"), on.alias("on")
    )
    tips = facts.select(
        F.inline(
            F.array(
                tip("unknown_apis", F.col("unknown"), F.col("unknown") > 0),
                tip("confident_but_reviewed", F.lit(0), F.coalesce(F.col("high") > 0.5, F.lit(False))),
                tip("no_auto_compliant", F.col("samples"), (F.col("passed") == 0) & (F.col("samples") > 0)),
                tip("errors", F.col("errors"), F.col("errors") > 0),
            )
        )
    ).withColumn("detail", F.lit(None).cast("string"))
    tips = tips.select("tip", "n", "detail", "on"
    ).filter("on").drop("on")
    first = review_reasons(samples, 1).select(
        F.lit("top_review_reason").alias("tip"), "n", F.col("reason").alias("detail")
    )
    return first.filter("detail <> '(auto)'").unionByName(tips)
