"""Gates that keep a call from being waved through; columns first, then one reason chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.config import AuditConfig
from callwarden.functions import calls
from callwarden.functions import patterns as P
from callwarden.functions.consts import per_session, strings

SCOPE_DECLARATION = r'(?iU)"consent_scope"\s*:\s*\[[^\]]*\]'


def is_obfuscated(stack: Column) -> Column:
    """A call of one- or two-letter names."""
    return stack.rlike("(?U)" + P.SHORT_CALL)


def sensitive_hint(stack: Column, body: Column) -> Column:
    """A telling word in the last two parts of any identifier, or anywhere in the parameters."""
    tails = F.transform(
        F.regexp_extract_all(stack, F.lit("(?U)" + P.IDENTIFIER), F.lit(0)),
        lambda name: F.substring_index(name, ".", -2),
    )
    words = "(?i)(" + vocab.SENSITIVE_PATTERN + ")"
    # a word in a tail is one in the stack, so most stacks need not be cut
    in_tail = stack.rlike(words) & F.array_join(tails, "\n").rlike(words)
    return in_tail | body.rlike(words)


def scope_contract(text: Column) -> Column:
    """Struct (declared, names): the first declared scope list of the text."""
    found = F.regexp_extract(text, SCOPE_DECLARATION, 0)
    inner = F.regexp_extract(found, r"\[([^\]]*)\]", 1)
    return F.struct(
        (found != "").alias("declared"),
        F.regexp_extract_all(inner, F.lit('"([A-Za-z_]+)"'), F.lit(1)).alias("names"),
    )


def scope_problem(scope: Column) -> Column:
    """Why the declared scope is unusable, NULL when it is fine."""
    unknown = F.filter(scope["names"], lambda n: ~n.isin(vocab.DATA_TYPES))
    return F.when(~scope["declared"], "contract_missing_consent_scope").when(
        F.size(F.array_except(scope["names"], strings(vocab.DATA_TYPES))) > 0,
        F.concat(
            F.lit("contract_unknown_scope_value:"), F.array_join(F.slice(unknown, 1, 3), ",")
        ),
    )


def empty_scope_problem(body: Column, raw_scope: Column) -> Column:
    """Strict reading of a declared-empty body.

    The body is wrapped beside a key derived from its own digest: only one complete JSON
    value leaves exactly these two keys. A strict body that is no variant repeats a key.
    """
    mark = F.concat(F.lit("k"), F.sha2(body, 256))
    wrapped = F.concat(F.lit('{"w":'), body, F.lit(',"'), mark, F.lit('":1}'))
    strict = F.coalesce(
        F.json_object_keys(wrapped) == F.array(F.lit("w"), mark), F.lit(False)
    )
    return (
        F.when(F.length(body) > vocab.MAX_BODY_CHARS, "empty_scope_oversized_body")
        .when(~strict, "empty_scope_unparseable_params")
        .when(F.try_parse_json(body).isNull(), "empty_scope_duplicate_key")
        .when(F.json_object_keys(body).isNull(), "empty_scope_params_not_object")
        .when(
            F.coalesce(raw_scope.cast("string") != "[]", F.lit(True)), "contract_scope_mismatch"
        )
    )


def audit_sample(fingerprint: Column, key: str, rate: float) -> Column:
    """Keyed draw per declaration shape; the same shape always draws the same lot.

    HMAC-SHA256 from two digests over padded keys; the first four bytes are the draw.
    """
    secret = key.encode()[:64].ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in secret))
    outer = F.lit(bytes(b ^ 0x5C for b in secret))
    digest = F.unhex(F.sha2(F.concat(inner, fingerprint.cast("binary")), 256))
    mac = F.sha2(F.concat(outer, digest), 256)
    draw = F.conv(F.substring(mac, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return draw < rate


@per_session
def _flag_columns() -> dict[str, Column]:
    untyped = F.col("data_type").isNull()
    return {
        "obfuscated": F.when(untyped, is_obfuscated(F.col("stack"))),
        "hinted": F.when(untyped, sensitive_hint(F.col("stack"), F.col("body"))),
        "scope": F.when(untyped, scope_contract(F.col("text"))),
        "fingerprint": calls.declaration_fingerprint(F.col("text"), F.col("body")),
    }


def gate_flags(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Add the row-local flags of calls without a data type.

    Needs ``text``, ``stack``, ``body``, ``data_type``, ``tier``, ``present``, ``raw``.
    """
    untyped = F.col("data_type").isNull()
    df = df.withColumns(_flag_columns())
    early = (
        F.when(
            F.col("tier").isin("class_ambiguous", "method_ambiguous"),
            "ambiguous_partial_identifier",
        )
        .when(F.col("tier") == "full_ambiguous", "ambiguous_api_contract_hit")
        .when(F.col("obfuscated"), "obfuscated_identifier_unresolved")
        .when(F.col("hinted"), "unknown_sensitive_api_hint")
    )
    if cfg.scope_contract:
        early = F.coalesce(early, scope_problem(F.col("scope")))
    df = df.withColumn("early_reason", F.when(untyped, early))
    open_gate = untyped & F.col("early_reason").isNull()
    empty = open_gate & (F.size("scope.names") == 0) if cfg.scope_contract else F.lit(False)
    df = df.withColumn(
        "strict_reason",
        F.when(empty, empty_scope_problem(F.col("body"), F.col("raw.consent_scope"))),
    )
    df = df.withColumn("at_empty_gate", empty & F.col("strict_reason").isNull())
    if cfg.audit_key and cfg.sampling_rate > 0:
        sampled = (
            audit_sample(F.col("fingerprint"), cfg.audit_key, cfg.sampling_rate)
            if cfg.sampling_rate < 1
            else F.lit(True)
        )
        return df.withColumn("sampled", F.when(F.col("at_empty_gate"), sampled))
    return df.withColumn("sampled", F.lit(False))


@per_session
def none_gate_reason(cfg: AuditConfig) -> Column:
    """First reason that stops a call without a data type; NULL lets it pass as NONE."""
    telling = (
        F.array_except("present", strings(["consent_scope"]))
        if cfg.scope_contract
        else F.col("present")
    )
    chain = (
        F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
        .when(F.col("strict_reason").isNotNull(), F.col("strict_reason"))
        .when(
            F.size("value_shapes") > 0,
            F.concat(
                F.lit("empty_scope_contradicted_by_values:"),
                F.array_join(F.slice("value_shapes", 1, 3), ","),
            ),
        )
        .when(
            F.col("suspicion").isNotNull(),
            F.concat(F.lit("empty_scope_structure_suspicious:"), F.col("suspicion")),
        )
        .when(F.col("sampled"), "scope_declaration_sampled_for_audit")
        .when(F.size(telling) > 0, "unresolved_dtype_but_signal_present")
        .when(
            (F.col("body") != "") & ~F.col("parsed_ok"), "params_unparseable_dtype_unknown"
        )
        .when(
            F.col("guard_type").isNotNull(),
            F.concat(F.lit("dtype_guard_conflict:"), F.col("guard_type")),
        )
    )
    if cfg.strict_none:
        keys_only = (F.size("object_keys") > 0) & ~F.arrays_overlap(
            "object_keys", strings(vocab.SIGNAL_KEYS)
        )
        chain = chain.when(keys_only, "contract_signal_absent_strict")
    return chain
