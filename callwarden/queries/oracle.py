"""Shared pieces of the DuckDB side: the same questions, asked relationally."""

from __future__ import annotations

from callwarden import vocab
from callwarden.operators import derived

TYPES = derived.TYPES
PURPOSE_CYCLE = (
    "core_function|account_security|verification|identity_verification|payment|analytics|"
    "security|health_service|social|marketing"
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def members(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def rows(table) -> str:
    return ", ".join(
        "(" + ", ".join(text(c) if isinstance(c, str) else str(c) for c in row) + ")" for row in table
    )


def h(i: int) -> str:
    return (
        f"((event_id*{7919 + 6151 * i} + user_id*{31 + 17 * i} + k*{104729 + 7907 * i}) % 1000003)"
    )


def pick(items: str, i: int) -> str:
    return f"split_part({text(items)}, '|', CAST(1 + {h(i)} % {items.count('|') + 1} AS INT))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


_token = " ".join(f"WHEN {text(p)} THEN {pick(items, 1)}" for p, items in derived.TOKENS.items())
_mode, _state, _scope, _told = f"({h(2)}%10)", f"({h(3)}%10)", f"({h(4)}%20)", f"({h(5)}%12)"
_crypto, _mask, _dest = f"({h(6)}%10)", f"({h(8)}%9)", f"({h(14)}%6)"


def _field(key: str, value: str) -> str:
    return f"'\"{key}\": \"' || ({value}) || '\"'"


CALLS = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
pl AS (SELECT *, {pick("android|ios|miniprogram|harmony", 0)} AS platform_true,
              {pick(TYPES, 1)} AS true_dt FROM ev),
tk AS (SELECT *, CASE platform_true {_token} END AS token FROM pl),
calls AS (SELECT event_id AS id, ts, user_id, event_type, value, true_dt, token,
  '[platform=' || platform_true || ']' || chr(10) || 'stack: com.app.u' || (user_id % 9 + 1)
  || '.Ui.onClick <- ' ||
  CASE WHEN {_mode} <= 5 THEN token
       WHEN {_mode} = 6 THEN 'a.b.' || split_part(replace(token,' ','.'), '.', -1)
       WHEN {_mode} = 7 THEN 'com.vendor.' || split_part(replace(token,' ','.'), '.', 1) || '.a'
       WHEN {_mode} = 8 THEN 'a.b' ELSE 'com.vendor.map.Tile.draw' END
  || '(F.java:' || (event_id % 900) || ')' || chr(10) || 'params: {{' ||
  concat_ws(', ',
    {_field("consent_state", f"CASE WHEN {_state}<=6 THEN 'granted' WHEN {_state}=7 THEN 'denied' WHEN {_state}=8 THEN 'revoked' END")},
    CASE WHEN {_scope}=1 THEN '"consent_scope": []' WHEN {_scope}=2 THEN '"consent_scope": ["NAME"]'
         WHEN {_scope}>2 THEN '"consent_scope": ["' || true_dt || '"]' END,
    CASE WHEN {_told}=0 THEN '"policy_disclosed": false' WHEN {_told}>1 THEN '"policy_disclosed": true' END,
    {_field("crypto", f"CASE WHEN {_crypto}=0 THEN {pick('none|raw|DES-ECB|AES-ECB', 7)} WHEN {_crypto}>1 THEN {pick('AES-256-GCM|TLS1.3|SM4-GCM', 7)} END")},
    {_field("pii_mask", f"CASE WHEN {_mask}=0 THEN 'raw' WHEN {_mask}<=2 THEN 'partial' WHEN {_mask}>3 THEN 'masked' END")},
    CASE WHEN {h(9)}%3=0 THEN {_field("biz_purpose", pick(PURPOSE_CYCLE, 10))} END,
    {_field("collect_scope", f"CASE WHEN {h(11)}%15=0 THEN 'all' WHEN {h(11)}%15 BETWEEN 1 AND 4 THEN 'minimal' END")},
    CASE WHEN {h(12)}%4=0 THEN '"retention_days": ' || ({h(13)}%730) END,
    {_field("data_destination", f"CASE WHEN {_dest}=0 THEN 'third_party' WHEN {_dest}<=2 THEN 'self' END")},
    CASE WHEN {h(15)}%3=0 THEN '"separate_consent": false' END) || '}}' AS text
  FROM tk)"""

SEGMENTS = """
seg AS (SELECT *, regexp_extract(text, '\\[platform=(\\w+)\\]', 1) AS platform,
  split_part(text, 'params: ', 1) AS stack, lower(split_part(text, 'params: ', 1)) AS low,
  split_part(text, 'params: ', 2) AS body FROM calls)"""

_cat = vocab.catalog_rows()
CATALOG = f"""
cat AS (SELECT DISTINCT platform, data_type, lower(token) AS token
        FROM (VALUES {rows(_cat)}) t(platform, data_type, token)),
cat_parts AS (SELECT platform, data_type, token AS raw,
    CASE WHEN contains(token,' ') THEN split_part(token,' ',1)
         WHEN contains(token,'.') THEN split_part(regexp_replace(token,'\\.[^.]*$',''),'.',-1)
         ELSE token END AS cls,
    CASE WHEN contains(token,' ') THEN substr(token, strpos(token,' ')+1)
         ELSE split_part(token,'.',-1) END AS mth
  FROM (VALUES {rows(_cat)}) t(platform, data_type, token)),
class_tok AS (SELECT DISTINCT platform, data_type, lower(cls) AS token FROM cat_parts
  WHERE length(cls)>=5 AND lower(cls) NOT IN {members(vocab.GENERIC_CLASSES)}),
method_tok AS (SELECT DISTINCT platform, data_type, lower(mth) AS token FROM cat_parts
  WHERE length(mth)>=8 AND (length(mth)>=10 OR length(regexp_replace(mth,'[^A-Z]','','g'))>=2)),
payload_tok AS (SELECT * FROM (VALUES {rows([(i, k, t) for i, (k, t) in enumerate(vocab.PAYLOAD_KEYS)])}) t(rank, key, data_type)),
risk AS (SELECT * FROM (VALUES {rows(list(enumerate(vocab.RISK_ORDER)))}) t(risk, data_type))"""

HITS = f"""
matched AS (SELECT DISTINCT s.id, c.data_type,
    CASE WHEN contains(s.low, c.token) THEN c.token ELSE replace(c.token,'.',' ') END AS variant
  FROM seg s JOIN cat c ON c.platform = s.platform AND c.token <> {text(vocab.RESOLVER_TOKEN)}
   AND (contains(s.low, c.token) OR contains(s.low, replace(c.token,'.',' ')))),
suppressed AS (SELECT * FROM matched m WHERE EXISTS (SELECT 1 FROM matched w
    WHERE w.id = m.id AND w.variant <> m.variant AND contains(w.variant, m.variant))),
full_hits AS (SELECT DISTINCT id, data_type FROM matched m WHERE NOT EXISTS (SELECT 1 FROM matched w
    WHERE w.id = m.id AND w.variant <> m.variant AND contains(w.variant, m.variant))),
class_hits AS (SELECT DISTINCT s.id, c.data_type FROM seg s JOIN class_tok c ON c.platform = s.platform
   AND regexp_matches(s.low, '(^|[^a-z0-9])' || c.token || '([^a-z0-9]|$)')),
method_hits AS (SELECT DISTINCT s.id, c.data_type FROM seg s JOIN method_tok c ON c.platform = s.platform
   AND regexp_matches(s.low, '(^|[^a-z0-9])' || c.token || '([^a-z0-9]|$)')),
payload_hits AS (SELECT s.id, p.rank, p.data_type FROM seg s JOIN payload_tok p
   ON regexp_matches(lower(s.text), '"' || p.key || '"\\s*:')),
scope_hits AS (SELECT s.id, r.data_type, r.risk FROM seg s JOIN risk r
   ON contains(regexp_extract(s.text, '(?i)"consent_scope"\\s*:\\s*\\[([^\\]]*)\\]', 1), '"' || r.data_type || '"')),
levels AS (SELECT id, 1 AS lvl, data_type FROM full_hits
  UNION ALL SELECT id, 2, data_type FROM class_hits UNION ALL SELECT id, 3, data_type FROM method_hits),
chosen AS (SELECT l.id, l.lvl, l.data_type FROM levels l
  JOIN (SELECT id, min(lvl) AS lvl FROM levels GROUP BY id) m USING (id, lvl)),
settled AS (SELECT c.id, any_value(c.lvl) AS lvl, count(*) AS n, min(c.data_type) AS only_type,
    count(p.data_type) AS n_backed, arg_min(p.data_type, r.risk) AS backed
  FROM chosen c LEFT JOIN (SELECT DISTINCT id, data_type FROM payload_hits) p
    ON p.id = c.id AND p.data_type = c.data_type
  LEFT JOIN risk r ON r.data_type = p.data_type GROUP BY c.id),
typed AS (SELECT s.*, t.lvl,
    CASE WHEN t.lvl IS NOT NULL THEN CASE WHEN t.n = 1 THEN t.only_type ELSE t.backed END
         ELSE coalesce(ph.data_type, sh.data_type) END AS dt,
    CASE WHEN t.lvl = 1 THEN CASE WHEN t.n = 1 OR t.n_backed = 1 THEN 'full' ELSE 'full_ambiguous' END
         WHEN t.lvl = 2 THEN CASE WHEN t.n = 1 OR t.n_backed > 0 THEN 'class' ELSE 'class_ambiguous' END
         WHEN t.lvl = 3 THEN CASE WHEN t.n = 1 OR t.n_backed > 0 THEN 'method' ELSE 'method_ambiguous' END
         WHEN ph.data_type IS NOT NULL THEN 'payload' WHEN sh.data_type IS NOT NULL THEN 'consent'
         ELSE 'none' END AS tier
  FROM seg s LEFT JOIN settled t ON t.id = s.id
  LEFT JOIN (SELECT id, arg_min(data_type, rank) AS data_type FROM payload_hits GROUP BY id) ph ON ph.id = s.id
  LEFT JOIN (SELECT id, arg_min(data_type, risk) AS data_type FROM scope_hits GROUP BY id) sh ON sh.id = s.id)"""

SIGNALS = """
sig AS (SELECT *, body->>'$.consent_state' AS cs, CAST(body->'$.consent_scope' AS VARCHAR[]) AS scope,
  CAST(body->>'$.policy_disclosed' AS BOOLEAN) AS told, body->>'$.crypto' AS crypto,
  body->>'$.pii_mask' AS mask, body->>'$.biz_purpose' AS purpose,
  body->>'$.collect_scope' AS collected, CAST(body->>'$.retention_days' AS BIGINT) AS days,
  body->>'$.data_destination' AS dest, CAST(body->>'$.separate_consent' AS BOOLEAN) AS separate
  FROM {source})"""


def signals(source: str) -> str:
    return SIGNALS.replace("{source}", source)


_allowed = " OR ".join(
    f"({{t}} = {text(t)} AND purpose IN {members(p)})" for t, p in vocab.PURPOSES.items()
)


def policy(t: str) -> str:
    """Verdict for type expression ``t`` over the columns of ``sig``."""
    allowed = _allowed.replace("{t}", t)
    return f"""CASE
    WHEN cs IS NULL AND scope IS NULL AND crypto IS NULL AND mask IS NULL THEN NULL
    WHEN NOT coalesce(cs = 'granted' AND list_contains(scope, {t}), false) THEN 'NO_CONSENT'
    WHEN told = false THEN 'NOT_DISCLOSED'
    WHEN crypto IN {members(vocab.BAD_CRYPTO)} THEN 'PLAINTEXT_TRANSMIT'
    WHEN mask = 'raw' OR (mask = 'partial' AND {t} IN {members(vocab.HIGH_SENSITIVITY)}) THEN 'NO_MASK'
    WHEN (purpose IS NOT NULL AND NOT ({allowed})) OR collected = 'all' THEN 'OVER_COLLECT'
    WHEN (dest = 'third_party' AND separate = false) OR days > {vocab.RETENTION_WARN_DAYS} THEN 'WARNING'
    ELSE 'COMPLIANT' END"""


HINT = "(?i)(" + vocab.SENSITIVE_PATTERN + ")"
_missing = "((cs IS NULL)::INT + (crypto IS NULL)::INT + (mask IS NULL)::INT)"
VERDICTS = f"""
pol AS (SELECT *, {policy("dt")} AS v, CASE {_missing} WHEN 0 THEN 0.99 WHEN 1 THEN 0.8 ELSE 0.55 END AS conf0,
   regexp_matches(stack, '(^|[^a-z0-9])[a-z][a-z0-9]?\\.[a-z][a-z0-9]?\\s*\\(') AS obf,
   regexp_matches(array_to_string(list_transform(regexp_extract_all(stack, '[A-Za-z_][\\w$]*(?:\\.[A-Za-z_][\\w$]*)*'),
      lambda x: regexp_extract(x, '[^.]*(\\.[^.]*)?$')), chr(10)), {text(HINT)})
     OR regexp_matches(body, {text(HINT)}) AS hint,
   list_concat(json_keys(body), [x for x in [cs, crypto, mask, purpose, collected, dest] if x IS NOT NULL]) AS toks
  FROM sig),
cap AS (SELECT *, coalesce(lvl IN (2,3), false) AS partial, lvl IS NULL AND dt IS NOT NULL AS indirect,
   coalesce(v = 'COMPLIANT', false) AND tier <> 'full' AS unsure,
   coalesce(v = 'COMPLIANT' AND NOT list_contains(scope, dt), false) AS clash FROM pol),
ver AS (SELECT *,
   CASE WHEN dt IS NULL OR v IS NULL THEN 0.0
        WHEN partial OR indirect OR unsure OR clash THEN least(conf0, 0.85) ELSE conf0 END AS confidence,
   CASE WHEN dt IS NOT NULL THEN CASE WHEN v IS NULL THEN 'compliance_metadata_unobservable' END
        WHEN tier IN ('class_ambiguous','method_ambiguous') THEN 'ambiguous_partial_identifier'
        WHEN tier = 'full_ambiguous' THEN 'ambiguous_api_contract_hit'
        WHEN obf THEN 'obfuscated_identifier_unresolved'
        WHEN hint THEN 'unknown_sensitive_api_hint'
        WHEN scope IS NULL THEN 'contract_missing_consent_scope'
        WHEN len(scope) = 0 THEN 'empty_scope_structure_suspicious:' ||
          CASE WHEN len([t for t in toks if length(t) >= 12 AND t <> 'consent_scope']) > 0
               THEN 'dense_token' ELSE 'integer_base_token' END
        ELSE 'unresolved_dtype_but_signal_present' END AS stopped,
   concat_ws(',', CASE WHEN partial THEN 'partial_identifier' END,
     CASE WHEN indirect THEN 'indirect_tier:' || tier END,
     CASE WHEN unsure THEN 'indirect_tier_compliant:' || tier END,
     CASE WHEN clash THEN 'contract_scope_contradiction' END,
     CASE WHEN cs IS NULL THEN 'no_consent_evidence' END,
     CASE WHEN crypto IS NULL THEN 'no_transport_info' END,
     CASE WHEN mask IS NULL THEN 'no_mask_info' END) AS reasons FROM cap),
verdicts AS (SELECT id, ts, user_id, event_type, text, true_dt, token, platform, body, tier, v AS raw_v,
   dt AS data_type, CASE WHEN dt IS NOT NULL THEN v END AS violation, confidence,
   stopped IS NOT NULL OR confidence < CASE WHEN tier = 'full' THEN 0.9 ELSE 0.9 END AS needs_review,
   CASE WHEN stopped IS NOT NULL THEN stopped WHEN confidence < 0.9 THEN reasons END AS review_reason,
   CASE WHEN dt IS NULL THEN 'UNKNOWN||UNKNOWN' ELSE dt || '||' || coalesce(v,'UNKNOWN') END AS combo,
   clash FROM ver)"""

CALL_CTES = [CALLS, SEGMENTS]
TYPED_CTES = [CALLS, SEGMENTS, CATALOG, HITS]
SIG_CTES = [CALLS, SEGMENTS, signals("seg")]
VERDICT_CTES = [CALLS, SEGMENTS, CATALOG, HITS, signals("typed"), VERDICTS]
TRUTH = f"truth AS (SELECT id, {policy('true_dt')} AS true_violation FROM sig)"
