"""Queries over captured calls: parsing, identification, policy, gates, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.config import AuditConfig
from callwarden.functions import calls as C
from callwarden.functions import policy, signals
from callwarden.functions.consts import strings
from callwarden.operators import evidence, gates, identify, learn, metrics, revocation
from callwarden.operators.staging import seal
from callwarden.plans.classify import classify_calls
from callwarden.queries import oracle as D
from callwarden.queries.base import calls, labelled_verdicts, segmented, signalled, verdicts

KEY = "audit-demo-key"


def call_segments(spark, sf):
    df = segmented(spark, sf)
    return df.select(
        "id",
        C.platform_tag(F.col("text")).alias("tag"),
        C.platform_infer(F.col("text")).alias("inferred"),
        "platform",
        F.size(C.stack_frames(F.col("stack"))).alias("n_frames"),
        F.length("body").alias("body_chars"),
        C.frame_api(F.col("text")).alias("api"),
        C.input_digest(F.col("text")).alias("digest"),
    )


CALL_SEGMENTS = D.with_(*D.CALL_CTES) + """
SELECT id, platform AS tag,
  CASE WHEN regexp_matches(text, '-\\[[A-Z]\\w+ [\\w:]+\\]') THEN 'ios'
       WHEN regexp_matches(text, 'wx\\.\\w+') THEN 'miniprogram'
       WHEN regexp_matches(text, '(?i)@?ohos\\.') THEN 'harmony' ELSE 'android' END AS inferred,
  platform, 1 + (length(stack) - length(replace(stack, ' <- ', ''))) // 4 AS n_frames,
  length(body) AS body_chars, trim(regexp_extract(text, 'stack: ([^<]+)', 1)) AS api,
  substr(sha1(text), 1, 16) AS digest FROM seg"""


def call_signals(spark, sf):
    df = signalled(spark, sf)
    return df.select(
        "id",
        "parsed_ok",
        F.size(signals.missing_signals()).alias("n_missing"),
        F.size("malformed").alias("n_malformed"),
        F.col("sig.consent_state").alias("consent_state"),
        F.array_join("sig.consent_scope", "|").alias("consent_scope"),
        F.col("sig.policy_disclosed").alias("policy_disclosed"),
        F.col("sig.retention_days").alias("retention_days"),
        F.col("sig.separate_consent").alias("separate_consent"),
        F.col("sig.crypto").alias("crypto"),
        policy.metadata_unobservable().alias("unobservable"),
    )


CALL_SIGNALS = D.with_(*D.SIG_CTES) + """
SELECT id, true AS parsed_ok, 15 - len(json_keys(body)) AS n_missing, 0 AS n_malformed,
  cs AS consent_state, array_to_string(scope, '|') AS consent_scope, told AS policy_disclosed,
  days AS retention_days, separate AS separate_consent, crypto,
  cs IS NULL AND scope IS NULL AND crypto IS NULL AND mask IS NULL AS unobservable FROM sig"""


def _mistyped(spark, sf):
    """Signals re-typed by event: text booleans, numbers as text, nulls, lists as text."""
    df = calls(spark, sf)
    kind = F.col("id") % 6
    flag = (
        F.when(kind == 0, '"false"').when(kind == 1, "1").when(kind == 2, '"maybe"')
        .when(kind == 3, "null").when(kind == 4, "true").otherwise("7")
    )
    days = (
        F.when(kind == 0, '"365"').when(kind == 1, "true").when(kind == 2, '" -12 "')
        .when(kind == 3, "null").when(kind == 4, '"x"').otherwise((F.col("id") % 500).cast("string"))
    )
    scope = (
        F.when(kind == 0, '"PHONE, NAME"').when(kind == 1, '["PHONE",null]')
        .when(kind == 2, "[1]").when(kind == 3, "null").when(kind == 4, "[]").otherwise('["EMAIL"]')
    )
    mask = F.when(kind == 0, "5").when(kind == 1, "[]").when(kind == 2, "true").otherwise('"raw"')
    body = F.concat(
        F.lit('{"policy_disclosed": '), flag, F.lit(', "retention_days": '), days,
        F.lit(', "consent_scope": '), scope, F.lit(', "pii_mask": '), mask, F.lit("}"),
    )
    return df.select("id", body.alias("body"))


def signal_types(spark, sf):
    df = signals.normalize_signals(signals.parse_signals(_mistyped(spark, sf)))
    return df.select(
        "id",
        F.array_join("malformed", ",").alias("malformed"),
        F.col("sig.policy_disclosed").alias("policy_disclosed"),
        F.col("sig.retention_days").alias("retention_days"),
        F.array_join("sig.consent_scope", "|").alias("consent_scope"),
        F.col("sig.pii_mask").alias("pii_mask"),
    )


SIGNAL_TYPES = """
SELECT event_id AS id,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'consent_scope,pii_mask,retention_days'
    WHEN 2 THEN 'consent_scope,policy_disclosed,pii_mask'
    WHEN 3 THEN 'consent_scope,policy_disclosed,retention_days'
    WHEN 4 THEN 'retention_days' ELSE 'policy_disclosed' END AS malformed,
  CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 4 THEN true END AS policy_disclosed,
  CASE event_id % 6 WHEN 0 THEN 365 WHEN 2 THEN -12 WHEN 5 THEN event_id % 500 END AS retention_days,
  CASE event_id % 6 WHEN 0 THEN 'PHONE|NAME' WHEN 4 THEN '' WHEN 5 THEN 'EMAIL' END AS consent_scope,
  CASE event_id % 6 WHEN 0 THEN '5' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'raw' END AS pii_mask
FROM events"""


def _broken(spark, sf):
    """Call bodies cut short or followed by text, by event."""
    df = segmented(spark, sf)
    kind = F.col("id") % 4
    cut = F.when(kind == 0, F.concat("body", F.lit(" // done"))).when(
        kind == 1, F.expr("substring(body, 1, length(body) - 1)")
    ).when(kind == 2, F.concat(F.lit("["), F.col("body"), F.lit("]"))).otherwise("no parameters")
    return df.select("id", cut.alias("body"), F.col("body").alias("whole"))


def signal_salvage(spark, sf):
    df = signals.normalize_signals(signals.parse_signals(_broken(spark, sf)))
    return df.select(
        "id", "parsed_ok", F.size("present").alias("n_present"),
        F.col("sig.consent_state").alias("consent_state"), F.col("sig.crypto").alias("crypto"),
    )


SIGNAL_SALVAGE = D.with_(*D.SIG_CTES) + """
SELECT id, id % 4 <> 3 AND len(json_keys(body)) > 0 OR id % 4 = 0 AS parsed_ok,
  CASE WHEN id % 4 = 3 THEN 0 ELSE len(json_keys(body)) END AS n_present,
  CASE WHEN id % 4 <> 3 THEN cs END AS consent_state,
  CASE WHEN id % 4 <> 3 THEN crypto END AS crypto FROM sig"""


def body_keys(spark, sf):
    """Top-level keys by kind: how often each key is a signal or payload."""
    df = signals.parse_signals(segmented(spark, sf))
    keys = df.select(
        F.explode("object_keys").alias("key"), signals.payload_keys().alias("payload")
    )
    return keys.groupBy("key", F.array_contains("payload", F.col("key")).alias("is_payload")).agg(
        F.count("*").alias("n")
    )


BODY_KEYS = D.with_(*D.CALL_CTES) + f"""
SELECT key, key NOT IN {D.members(vocab.SIGNAL_KEYS)} AS is_payload, count(*) AS n
FROM (SELECT unnest(json_keys(body)) AS key FROM seg) GROUP BY 1, 2"""


def flatten_json(spark, sf):
    """Scalars, key names and depth of nested bodies."""
    df = segmented(spark, sf).withColumn(
        "body",
        F.concat(
            F.lit('{"meta": '), F.col("body"), F.lit(', "tags": ['), (F.col("id") % 7).cast("string"),
            F.lit(', "t'), F.col("id").cast("string"), F.lit('", null, true], "consent_scope": ["X"]}'),
        ),
    )
    df = evidence.flatten_body(df)
    return df.select(
        "id",
        F.size("leaves").alias("n_leaves"),
        F.size("names").alias("n_names"),
        F.array_join(F.array_sort("leaves"), "|").alias("leaves"),
        "depth",
    )


FLATTEN_JSON = D.with_(*D.SIG_CTES) + """,
f AS (SELECT id, scope, list_concat([x for x in [cs, crypto, mask, purpose, collected, CAST(days AS VARCHAR), dest] if x IS NOT NULL],
  coalesce(scope, []), [CAST(id % 7 AS VARCHAR), 't' || id]) AS leaves, len(json_keys(body)) AS nk FROM sig)
SELECT id, len(leaves) AS n_leaves, nk - (scope IS NOT NULL)::INT + 2 AS n_names,
  array_to_string(list_sort(leaves), '|') AS leaves,
  CASE WHEN len(scope) > 0 THEN 3 ELSE 2 END AS depth FROM f"""


def declaration_shapes(spark, sf):
    """Calls per declaration shape, with the keyed audit draw of each shape."""
    df = segmented(spark, sf)
    df = df.select(C.declaration_fingerprint(F.col("text"), F.col("body")).alias("fingerprint"))
    shapes = df.groupBy("fingerprint").agg(F.count("*").alias("n"))
    draw = gates.audit_sample(F.col("fingerprint"), KEY, 0.25)
    return shapes.withColumn("sampled", draw)


def _hmac(message: str) -> str:
    secret = KEY.encode()[:64].ljust(64, b"\0")
    pad = lambda x: "".join(f"{b ^ x:02x}" for b in secret)
    inner = f"sha256(unhex('{pad(0x36)}') || encode({message}))"
    return f"sha256(unhex('{pad(0x5C)}') || unhex({inner}))"


DECLARATION_SHAPES = D.with_(*D.CALL_CTES) + f""",
fp AS (SELECT platform || '|empty=' || CASE WHEN contains(body, '"consent_scope": []') THEN '1' ELSE '0' END
   || '|' || array_to_string(list_sort(json_keys(body)), ',') AS fingerprint FROM seg),
g AS (SELECT fingerprint, count(*) AS n FROM fp GROUP BY 1)
SELECT fingerprint, n, CAST('0x' || substr({_hmac('fingerprint')}, 1, 8) AS BIGINT) / 4294967296.0 < 0.25 AS sampled FROM g"""


def api_usage(spark, sf):
    """Calls and distinct users per catalogue token that occurs in a stack."""
    df = identify.match_catalog(segmented(spark, sf), vocab.catalog_rows())
    hits = df.select("user_id", "scope_key", F.explode("matched").alias("m"))
    hits = hits.select("user_id", F.col("scope_key").alias("platform"), "m.variant", F.explode("m.types").alias("data_type"))
    return hits.groupBy("platform", "variant", "data_type").agg(
        F.count("*").alias("n_calls"), F.countDistinct("user_id").alias("n_users")
    )


API_USAGE = D.with_(*D.TYPED_CTES) + """
SELECT s.platform, variant, data_type, count(*) AS n_calls, count(DISTINCT user_id) AS n_users
FROM matched m JOIN seg s USING (id) GROUP BY 1, 2, 3"""


def suppressed_hits(spark, sf):
    df = identify.match_catalog(segmented(spark, sf), vocab.catalog_rows())
    types = df.select(F.explode("suppressed").alias("m")).select(F.explode("m.types").alias("data_type"))
    return types.groupBy("data_type").agg(F.count("*").alias("n"))


SUPPRESSED_HITS = D.with_(*D.TYPED_CTES) + """
SELECT data_type, count(*) AS n FROM suppressed GROUP BY 1"""


def type_evidence(spark, sf):
    """Evidence of every tier per call: full, class, method, payload, declared scope."""
    df = identify.identify(segmented(spark, sf), vocab.catalog_rows())
    listed = lambda c: F.array_join(F.array_sort(c), "|")
    return df.select(
        "id",
        listed("full_types").alias("full_types"),
        listed("class_types").alias("class_types"),
        listed("method_types").alias("method_types"),
        "payload_first",
        "data_type",
        "tier",
    )


TYPE_EVIDENCE = D.with_(*D.TYPED_CTES) + """,
j AS (SELECT t.id, t.dt, t.tier,
  (SELECT string_agg(data_type, '|' ORDER BY data_type) FROM full_hits f WHERE f.id = t.id) AS f,
  (SELECT string_agg(data_type, '|' ORDER BY data_type) FROM class_hits f WHERE f.id = t.id) AS c,
  (SELECT string_agg(data_type, '|' ORDER BY data_type) FROM method_hits f WHERE f.id = t.id) AS m,
  (SELECT arg_min(data_type, rank) FROM payload_hits f WHERE f.id = t.id) AS p FROM typed t)
SELECT id, coalesce(f, '') AS full_types,
  CASE WHEN f IS NULL THEN coalesce(c, '') END AS class_types,
  CASE WHEN f IS NULL AND c IS NULL THEN coalesce(m, '') END AS method_types,
  p AS payload_first, dt AS data_type, tier FROM j"""


def payload_disambiguation(spark, sf):
    """Ambiguous and unknown APIs beside payload keys; URIs decide resolver queries."""
    kind = F.col("id") % 5
    frame = (
        F.when(kind == 0, "CNContactStore unifiedContacts")
        .when(kind == 1, "CNContactStore unifiedContacts")
        .when(kind == 2, "android.content.ContentResolver.query content://sms/inbox")
        .when(kind == 3, "ContentResolver.query plain")
        .otherwise("com.z.y.Widget.refresh")
    )
    body = (
        F.when(kind == 0, '{"realname": "x"}')
        .when(kind == 1, '{"name": "x", "contacts" : []}')
        .when(kind == 4, '{"audio": 1, "lat": 2}')
        .otherwise('{"n": 1}')
    )
    platform = F.when(kind <= 1, "ios").otherwise("android")
    df = calls(spark, sf).select(
        "id",
        F.concat(F.lit("[platform="), platform, F.lit("]\nstack: "), frame, F.lit("\nParams : "), body).alias("text"),
    )
    from callwarden.plans.classify import with_segments

    df = identify.identify(with_segments(seal(df, "text")), vocab.catalog_rows())
    return df.select("id", "data_type", "tier")


PAYLOAD_DISAMBIGUATION = """
SELECT event_id AS id,
  CASE event_id % 5 WHEN 0 THEN 'NAME' WHEN 1 THEN 'CONTACTS' WHEN 2 THEN 'SMS' WHEN 4 THEN 'LOCATION' END AS data_type,
  CASE event_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'full_ambiguous' WHEN 2 THEN 'full' WHEN 3 THEN 'class_ambiguous' ELSE 'payload' END AS tier
FROM events"""


def policy_verdicts(spark, sf):
    df = signalled(spark, sf)
    v = policy.decide_ex(F.col("true_dt"), F.col("malformed"))
    df = df.select("id", "true_dt", v.alias("v"), policy.consent_valid(F.col("true_dt")).alias("consent"),
                   policy.rule_confidence().alias("confidence"))
    df = seal(df, "v", "consent", "confidence")
    return df.select(
        "id",
        F.col("v.violation").alias("violation"),
        policy.decide_conservative(F.col("v")).alias("conservative"),
        F.col("v.bounds.pessimistic").alias("pessimistic"),
        "consent",
        "confidence",
        C.severity(F.col("v.violation")).alias("severity"),
        C.build_combo(F.col("true_dt"), F.col("v.violation")).alias("combo"),
    )


POLICY_VERDICTS = D.with_(*D.SIG_CTES) + f""",
p AS (SELECT *, {D.policy("true_dt")} AS v FROM sig)
SELECT id, v AS violation, coalesce(v, 'NO_CONSENT') AS conservative,
  CASE WHEN v IS NULL THEN 'NO_CONSENT' END AS pessimistic,
  CASE WHEN cs IN ('denied', 'revoked') THEN false WHEN cs = 'granted' THEN coalesce(list_contains(scope, true_dt), false) END AS consent,
  CASE {D._missing} WHEN 0 THEN 0.99 WHEN 1 THEN 0.8 ELSE 0.55 END AS confidence,
  CASE v WHEN 'NO_CONSENT' THEN 0 WHEN 'NOT_DISCLOSED' THEN 1 WHEN 'PLAINTEXT_TRANSMIT' THEN 2
    WHEN 'NO_MASK' THEN 3 WHEN 'OVER_COLLECT' THEN 4 WHEN 'WARNING' THEN 5 ELSE 7 END AS severity,
  true_dt || '||' || coalesce(v, 'COMPLIANT') AS combo FROM p"""


def consent_log_paths(spark, sf):
    """Consent proven by a log line instead of a state."""
    kind = F.col("id") % 4
    log = (
        F.when(kind == 0, F.concat(F.lit("granted:SMS, "), F.col("true_dt")))
        .when(kind == 1, "granted:SMS")
        .when(kind == 2, "revoked@2024-01-01")
        .otherwise("absent")
    )
    df = calls(spark, sf).select(
        "id", "true_dt",
        F.concat(F.lit('{"consent_log": "'), log, F.lit('", "transport": "'),
                 F.when(F.col("id") % 3 == 0, "http").otherwise("https"), F.lit('"}')).alias("body"),
    )
    df = signals.normalize_signals(signals.parse_signals(df))
    v = policy.decide_ex(F.col("true_dt"), F.col("malformed"))
    return df.groupBy("true_dt", v["violation"].alias("violation"), policy.consent_valid(F.col("true_dt")).alias("consent")).agg(
        F.count("*").alias("n")
    )


CONSENT_LOG_PATHS = D.with_(D.CALLS) + """,
c AS (SELECT true_dt, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN true_dt = 'SMS' WHEN 2 THEN false END AS consent, id FROM calls)
SELECT true_dt, CASE WHEN NOT coalesce(consent, false) THEN 'NO_CONSENT' WHEN id % 3 = 0 THEN 'PLAINTEXT_TRANSMIT'
   ELSE 'COMPLIANT' END AS violation, consent, count(*) AS n FROM c GROUP BY 1, 2, 3"""


def purpose_fit(spark, sf):
    """Declared purposes against the whitelist of the true type."""
    df = signalled(spark, sf).filter("sig.biz_purpose is not null")
    ok = policy.purpose_allowed(F.col("true_dt"), F.col("sig.biz_purpose"))
    return df.groupBy("true_dt", F.col("sig.biz_purpose").alias("purpose"), ok.alias("allowed")).agg(
        F.count("*").alias("n")
    )


_allowed = D._allowed.replace("{t}", "true_dt")
PURPOSE_FIT = D.with_(*D.SIG_CTES) + f"""
SELECT true_dt, purpose, ({_allowed}) AS allowed, count(*) AS n FROM sig WHERE purpose IS NOT NULL GROUP BY 1, 2, 3"""


def gate_flags(spark, sf):
    """Obfuscation, telling words and the scope contract on every call."""
    df = segmented(spark, sf).withColumn("scope", gates.scope_contract(F.col("text")))
    return df.select(
        "id",
        gates.is_obfuscated(F.col("stack")).alias("obfuscated"),
        gates.sensitive_hint(F.col("stack"), F.col("body")).alias("hinted"),
        gates.scope_problem(F.col("scope")).alias("scope_problem"),
        (F.col("scope.declared") & (F.size("scope.names") == 0)).alias("declared_empty"),
    )


GATE_FLAGS = D.with_(*D.CALL_CTES, D.signals("seg")) + f"""
SELECT id, regexp_matches(stack, '(^|[^a-z0-9])[a-z][a-z0-9]?\\.[a-z][a-z0-9]?\\s*\\(') AS obfuscated,
  regexp_matches(array_to_string(list_transform(regexp_extract_all(stack, '[A-Za-z_][\\w$]*(?:\\.[A-Za-z_][\\w$]*)*'),
      lambda x: regexp_extract(x, '[^.]*(\\.[^.]*)?$')), chr(10)), {D.text(D.HINT)})
     OR regexp_matches(body, {D.text(D.HINT)}) AS hinted,
  CASE WHEN scope IS NULL THEN 'contract_missing_consent_scope' END AS scope_problem,
  coalesce(len(scope) = 0, false) AS declared_empty FROM sig"""


def empty_scope_checks(spark, sf):
    """Strict reading of declared-empty bodies with every kind of defect."""
    kind = F.col("id") % 8
    n = F.col("id").cast("string")
    body = (
        F.when(kind == 0, F.concat(F.lit('{"consent_scope": [], "n": '), n, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"consent_scope": [], "n": '), n, F.lit("} tail")))
        .when(kind == 2, F.concat(F.lit('{"consent_scope": [], "a": '), n, F.lit(', "a": 2}')))
        .when(kind == 3, F.concat(F.lit('{"consent_scope": [], "m": {"a": '), n, F.lit(', "a": 2}}')))
        .when(kind == 4, F.concat(F.lit('[{"consent_scope": [], "n": '), n, F.lit("}]")))
        .when(kind == 5, F.concat(F.lit('{"m": {"consent_scope": []}, "n": '), n, F.lit("}")))
        .when(kind == 6, F.concat(F.lit('{"consent_scope": [null], "n": '), n, F.lit("}")))
        .otherwise(F.concat(F.lit('{"consent_scope": [], "n": '), n))
    )
    df = signals.parse_signals(calls(spark, sf).select("id", body.alias("body")))
    return df.select(
        "id", gates.empty_scope_problem(F.col("body"), F.col("raw.consent_scope")).alias("problem")
    )


EMPTY_SCOPE_CHECKS = """
SELECT event_id AS id, CASE event_id % 8 WHEN 1 THEN 'empty_scope_unparseable_params'
  WHEN 2 THEN 'empty_scope_duplicate_key' WHEN 3 THEN 'empty_scope_duplicate_key'
  WHEN 4 THEN 'empty_scope_params_not_object' WHEN 5 THEN 'contract_scope_mismatch'
  WHEN 6 THEN 'contract_scope_mismatch' WHEN 7 THEN 'empty_scope_unparseable_params' END AS problem FROM events"""


def classify(spark, sf):
    return verdicts(spark, sf).select(
        "id", "combo", "data_type", "violation", "confidence", "tier", "needs_review", "review_reason", "auto_lambda"
    )


CLASSIFY = D.with_(*D.VERDICT_CTES) + """
SELECT id, combo, data_type, violation, confidence, tier, needs_review, review_reason, 0.9 AS auto_lambda FROM verdicts"""


def review_mix(spark, sf):
    """Verdicts by platform: the flagship table."""
    df = verdicts(spark, sf)
    return df.groupBy(
        C.platform_tag(F.col("text")).alias("platform"), F.coalesce("violation", F.lit("UNKNOWN")).alias("violation")
    ).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"))


REVIEW_MIX = D.with_(*D.VERDICT_CTES) + """
SELECT platform, coalesce(violation, 'UNKNOWN') AS violation, count(*) AS n,
  count(*) FILTER (WHERE needs_review) AS n_review FROM verdicts GROUP BY 1, 2"""


def relaxed_options(spark, sf):
    """The same calls with indirect autopass and a raised global threshold."""
    passed = verdicts(spark, sf, AuditConfig(indirect_autopass=True))
    strict = verdicts(spark, sf, AuditConfig(auto_lambda=0.995))
    pick = lambda df, name: df.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review")).select(
        F.lit(name).alias("setting"), "tier", "n", "n_review"
    )
    return pick(passed, "autopass").unionByName(pick(strict, "lambda_0.995"))


RELAXED_OPTIONS = D.with_(*D.VERDICT_CTES) + f""",
x AS (SELECT verdicts.tier, verdicts.needs_review, data_type, violation, verdicts.raw_v,
   CASE {D._missing} WHEN 0 THEN 0.99 WHEN 1 THEN 0.8 ELSE 0.55 END AS conf0 FROM verdicts JOIN sig USING (id))
SELECT 'autopass' AS setting, tier, count(*) AS n, count(*) FILTER (WHERE
  CASE WHEN tier IN ('payload','consent') AND raw_v <> 'COMPLIANT' THEN conf0 < 0.9 ELSE needs_review END) AS n_review
FROM x GROUP BY 1, 2 UNION ALL
SELECT 'lambda_0.995', tier, count(*), count(*) FROM x GROUP BY 1, 2"""


def contradiction_revocation(spark, sf):
    """Declared-empty shapes sent to review after an earlier detection of the same shape."""
    df = verdicts(spark, sf).select("id", "ts", "fingerprint", "at_empty_gate", "detected")
    df = df.withColumn("pos", F.struct("ts", "id"))
    hit = F.col("id") % 11 == 0
    df = df.withColumn("detected", F.col("detected") | (hit & F.col("at_empty_gate")))
    df = seal(df, "detected", "pos")
    first = revocation.first_detections(df, F.col("detected"))
    out = revocation.mark_revoked(df, first)
    return out.groupBy("fingerprint").agg(
        F.count("*").alias("n"),
        F.count_if("detected").alias("n_detected"),
        F.count_if(F.col("is_revoked") & F.col("at_empty_gate")).alias("n_revoked"),
    )


CONTRADICTION_REVOCATION = D.with_(*D.VERDICT_CTES) + """,
r AS (SELECT id, ts, platform || '|empty=' || CASE WHEN contains(body, '"consent_scope": []') THEN '1' ELSE '0' END
   || '|' || array_to_string(list_sort(json_keys(body)), ',') AS fingerprint,
   coalesce(review_reason LIKE 'empty_scope_structure%', false) AS gate, clash FROM verdicts),
d AS (SELECT *, clash OR (gate AND id % 11 = 0) AS detected FROM r),
w AS (SELECT *, coalesce(sum(detected::INT) OVER (PARTITION BY fingerprint ORDER BY ts, id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS seen FROM d)
SELECT fingerprint, count(*) AS n, count(*) FILTER (WHERE detected) AS n_detected,
  count(*) FILTER (WHERE seen AND gate) AS n_revoked FROM w GROUP BY 1"""


def audited_classify(spark, sf):
    """Verdicts with a secret audit key: sampling and revocation active."""
    cfg = AuditConfig(audit_key=KEY, audit_permille=250)
    df = verdicts(spark, sf, cfg, ["ts", "id"])
    reason = F.coalesce(F.split("review_reason", ":")[0], F.lit("(auto)"))
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


AUDITED_CLASSIFY = D.with_(*D.VERDICT_CTES) + """,
r AS (SELECT *, platform || '|empty=' || CASE WHEN contains(body, '"consent_scope": []') THEN '1' ELSE '0' END
   || '|' || array_to_string(list_sort(json_keys(body)), ',') AS fingerprint FROM verdicts),
w AS (SELECT *, coalesce(sum(clash::INT) OVER (PARTITION BY fingerprint ORDER BY ts, id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS seen FROM r)
SELECT CASE WHEN seen AND review_reason LIKE 'empty_scope_structure%' THEN 'scope_declaration_revoked'
   ELSE coalesce(split_part(review_reason, ':', 1), '(auto)') END AS reason, count(*) AS n FROM w GROUP BY 1"""


def feature_tokens(spark, sf):
    """Document frequency of type and signal feature tokens."""
    df = signals.parse_signals(segmented(spark, sf))
    tokens = F.array_union(
        learn.dtype_features(F.col("text"), F.col("stack"), F.col("body")), learn.signal_features()
    )
    return df.select(F.explode(tokens).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


FEATURE_TOKENS = D.with_(*D.SIG_CTES) + """,
fr AS (SELECT id, unnest(regexp_extract_all(stack, '(?:<- |stack: )([A-Za-z_][\\w.$]*\\.[A-Za-z_]\\w*)\\s*\\(', 1)) AS f FROM sig),
feats AS (SELECT id, 'plat=' || platform AS feature FROM sig
  UNION SELECT id, 'api=' || f FROM fr UNION SELECT id, 'cls=' || split_part(f, '.', -2) FROM fr
  UNION SELECT id, k || '=' || coalesce(v, '<MISSING>') FROM (SELECT id, unnest([
   {k: 'consent_state', v: cs}, {k: 'consent_scope', v: array_to_string(list_sort(scope), '|')},
   {k: 'policy_disclosed', v: CAST(told AS VARCHAR)}, {k: 'crypto', v: crypto}, {k: 'pii_mask', v: mask},
   {k: 'biz_purpose', v: purpose}, {k: 'collect_scope', v: collected}, {k: 'retention_days', v: CAST(days AS VARCHAR)},
   {k: 'data_destination', v: dest}, {k: 'separate_consent', v: CAST(separate AS VARCHAR)},
   {k: 'consent_version_expired', v: NULL}, {k: 'consent_log', v: NULL}, {k: 'policy_updated_after_consent', v: NULL},
   {k: 'transport', v: NULL}, {k: 'extra_fields_collected', v: NULL}], recursive := true) FROM sig))
SELECT feature, count(*) AS n FROM feats GROUP BY 1"""


def signal_codes(spark, sf):
    """Category codes of the scalar signals and the mean of each scope indicator."""
    df = signals.parse_signals(segmented(spark, sf))
    codes = learn.signal_encoder(df).select("field", "value", F.col("n").cast("double").alias("n"), "code")
    flags = df.select(learn.scope_vector().alias("v")).select(F.posexplode("v").alias("i", "flag"))
    flags = flags.groupBy("i", "flag").agg(F.count("*").alias("n"))
    return codes.unionByName(
        flags.select(
            F.lit("consent_scope").alias("field"),
            F.concat(F.get(strings(vocab.PERSONAL_TYPES), F.col("i")), F.lit("="), F.col("flag").cast("string")).alias("value"),
            F.col("n").cast("double").alias("n"),
            F.lit(-1).alias("code"),
        )
    )


SIGNAL_CODES = D.with_(*D.SIG_CTES) + f""",
p AS (SELECT unnest([
   {{field: 'consent_state', value: cs}}, {{field: 'policy_disclosed', value: CAST(told AS VARCHAR)}},
   {{field: 'crypto', value: crypto}}, {{field: 'pii_mask', value: mask}}, {{field: 'biz_purpose', value: purpose}},
   {{field: 'collect_scope', value: collected}}, {{field: 'retention_days', value: CAST(days AS VARCHAR)}},
   {{field: 'data_destination', value: dest}}, {{field: 'separate_consent', value: CAST(separate AS VARCHAR)}},
   {{field: 'consent_version_expired', value: NULL}}, {{field: 'consent_log', value: NULL}},
   {{field: 'policy_updated_after_consent', value: NULL}}, {{field: 'transport', value: NULL}},
   {{field: 'extra_fields_collected', value: NULL}}], recursive := true) FROM sig),
c AS (SELECT field, coalesce(value, '<MISSING>') AS value, count(*) AS n FROM p GROUP BY 1, 2),
k AS (SELECT field, value, CAST(n AS DOUBLE) AS n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) - 1 AS code FROM c)
SELECT * FROM k UNION ALL
SELECT 'consent_scope', t || '=' || CASE WHEN scope IS NULL THEN 2 WHEN list_contains(scope, t) THEN 1 ELSE 0 END,
  CAST(count(*) AS DOUBLE), -1 FROM sig, (SELECT unnest({D.texts(vocab.PERSONAL_TYPES)}) AS t) GROUP BY 2"""


QUERIES = {
    "call_segments": (call_segments, CALL_SEGMENTS),
    "call_signals": (call_signals, CALL_SIGNALS),
    "signal_types": (signal_types, SIGNAL_TYPES),
    "signal_salvage": (signal_salvage, SIGNAL_SALVAGE),
    "body_keys": (body_keys, BODY_KEYS),
    "flatten_json": (flatten_json, FLATTEN_JSON),
    "declaration_shapes": (declaration_shapes, DECLARATION_SHAPES),
    "api_usage": (api_usage, API_USAGE),
    "suppressed_hits": (suppressed_hits, SUPPRESSED_HITS),
    "type_evidence": (type_evidence, TYPE_EVIDENCE),
    "payload_disambiguation": (payload_disambiguation, PAYLOAD_DISAMBIGUATION),
    "policy_verdicts": (policy_verdicts, POLICY_VERDICTS),
    "consent_log_paths": (consent_log_paths, CONSENT_LOG_PATHS),
    "purpose_fit": (purpose_fit, PURPOSE_FIT),
    "gate_flags": (gate_flags, GATE_FLAGS),
    "empty_scope_checks": (empty_scope_checks, EMPTY_SCOPE_CHECKS),
    "classify": (classify, CLASSIFY),
    "review_mix": (review_mix, REVIEW_MIX),
    "relaxed_options": (relaxed_options, RELAXED_OPTIONS),
    "contradiction_revocation": (contradiction_revocation, CONTRADICTION_REVOCATION),
    "audited_classify": (audited_classify, AUDITED_CLASSIFY),
    "feature_tokens": (feature_tokens, FEATURE_TOKENS),
    "signal_codes": (signal_codes, SIGNAL_CODES),
}
