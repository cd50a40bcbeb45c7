"""Golden rows and brute-force checks that DuckDB cannot express."""

import random
import re

from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.config import AuditConfig
from callwarden.functions import patterns as P
from callwarden.functions import text as X
from callwarden.operators import catalog, metrics, restore, scan
from callwarden.plans.classify import classify_calls
from callwarden.plans.funnel import run_funnel

# --- fixed values: malformed inputs that must go to review, never crash ---
MALFORMED = [
    "",
    "   \n\t  ",
    "\\x00\\x01\\xff\\xfe abcd",
    'stack: LocationManager.getLastKnownLocation\nparams: {"crypto":"none"}',
    "[platform=android]\nstack: TelephonyManager.getImei\nparams: {broken json",
    "[platform=android]\nstack: TelephonyManager.getImei(T.java:1)",
    '[platform=android]\nparams: {"consent_state":"granted"}',
    "[platform=ios]",
    "[platform=android]\nstack: " + "A" * 50000 + '\nparams: {"crypto":"none"}',
    "[platform=android]\nstack: TelephonyManager.getImei\nparams: " + '{"a":' * 50 + "1" + "}" * 50,
    '[platform=android]\nstack: <script>alert(1)</script>\nparams: {"k":"\'\\"; DROP TABLE--"}',
    '[platform=harmony]\nstack: 相机.拍照()\nparams: {"备注":"用户同意✅"}',
    "[platform=android]\nstack: TelephonyManager.getImei\x00\nparams: {}",
    "[platform=android]\nstack: TelephonyManager.getImei\nparams: 12345",
    "[platform=android]\nstack: TelephonyManager.getImei\nparams: [1,2,3]",
    '[platform=windows]\nstack: TelephonyManager.getImei\nparams: {"crypto":"none"}',
    "[platform=android]\nstack: Camera.open\nparams: {}",
]
SAFE = (
    "[platform=android]\nstack: com.app.Ui.onClick <- android.telephony.TelephonyManager.getDeviceId(T.java:1)\n"
    'params: {"consent_state": "granted", "consent_scope": ["DEVICE_ID"], "crypto": "TLS1.3",'
    ' "pii_mask": "masked", "policy_disclosed": true}'
)
NONE = '[platform=miniprogram]\nstack: tiles.redraw(x.js:1)\nparams: {"consent_scope": [], "ts": "ok"}'


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_malformed_inputs_never_pass(spark):
    out = classify_calls(table(spark, MALFORMED))
    rows = out.collect()
    assert len(rows) == len(MALFORMED)
    assert metrics.redline_breaches(out).count() == 0
    assert all(r.needs_review for r in rows)


def test_tiers_that_may_pass(spark):
    rows = {r.id: r for r in classify_calls(table(spark, [SAFE, NONE])).collect()}
    assert (rows[0].combo, rows[0].tier, rows[0].needs_review) == ("DEVICE_ID||COMPLIANT", "full", False)
    assert (rows[1].combo, rows[1].tier, rows[1].needs_review) == ("NONE||COMPLIANT", "none_verified", False)


def test_oversized_calls_go_to_review_unread(spark):
    df = table(spark, [SAFE, NONE])
    limit = AuditConfig(max_text_chars=len(SAFE) - 1)
    rows = {r.id: r for r in classify_calls(df, limit).collect()}
    assert (rows[0].combo, rows[0].review_reason) == ("UNKNOWN||UNKNOWN", "input_oversized")
    assert rows[0].needs_review and rows[0].confidence == 0.0 and rows[0].text == SAFE
    assert (rows[1].combo, rows[1].needs_review) == ("NONE||COMPLIANT", False)



def test_raising_the_threshold_only_adds_reviews(spark):
    texts = table(spark, [*MALFORMED, SAFE, NONE])
    base = {r.id for r in classify_calls(texts).filter("not needs_review").collect()}
    strict = classify_calls(texts, AuditConfig(auto_lambda=0.995)).filter("not needs_review")
    assert {r.id for r in strict.collect()} <= base


def test_funnel_stops_residue(spark):
    coded = '[platform=android]\nstack: a.b.c\nparams: {"v": "b64:YWJjZGVmZ2hpamtsbW5vcA=="}'
    rows = {r.id: r for r in run_funnel(table(spark, [coded, SAFE])).collect()}
    assert rows[0].review_reason == "L2_input_residual:encoded_token" and rows[0].needs_human
    assert rows[1].decision == "COMPLIANT" and rows[1].final_layer == "rules"


def test_scrub_masks_and_keeps(spark):
    mask = {
        "13800138000": "<PHONE>", "110101199003078515": "<IDCARD>", "6222021234567890123": "<BANKCARD>",
        "alice@example.com": "<EMAIL>", "https://a.example/x?token=1": "<URL>",
        "eyJhbGciOiJIUzI1NiJ9": "<blob", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6": "<blob",
        "YWJjZGVmZ2hpamtsbW5vcA==": "<blob",
    }
    keep = [
        "1790220775396", "-@ohos.payment", "@ohos.identifier.oaid", "RIVERViewControllerBridgeLegacy",
        "getLastKnownLocationInternal", "subscriberCellularProviderWithCompletion",
        "Lcom/tencent/mm/plugin/Test;", "com.kuaishou.security.DeviceUtils.getImei",
    ]
    df = table(spark, [*mask, *keep]).select("text", X.scrub_str(F.col("text")).alias("s"))
    got = {r.text: r.s for r in df.collect()}
    assert all(expected in got[s] for s, expected in mask.items())
    assert all(got[s] == s for s in keep)


def test_revocation_follows_order(spark):
    body = '{"consent_scope": [], "event": "%s"}'
    call = "[platform=android]\nstack: com.cloud.bridge.Sync.pull(X.kt:1)\nparams: " + body
    texts = table(spark, [call % "ok", call % "13800138000", call % "ok"])
    cfg = AuditConfig(audit_key="k")
    rows = {r.id: r.review_reason for r in classify_calls(texts, cfg).collect()}
    assert rows[1].startswith("empty_scope_contradicted_by_values:mobile")
    assert rows[2] == "scope_declaration_revoked"
    assert rows[0] != "scope_declaration_revoked"


def test_look_alike_table_is_complete():
    assert len(P.CONFUSABLE_FROM) == len(P.CONFUSABLE_TO) == len(set(P.CONFUSABLE_FROM))
    assert len(vocab.combos()) == 92
    assert len(vocab.catalog_rows()) == 113


def greedy_merge(base, candidates):
    """One candidate after the other, as a plain loop."""
    types, out = {}, {}
    for p, d, t in base:
        types.setdefault((p, t.lower()), set()).add(d)
    for p, d, t, _ in candidates:
        own = types.get((p, t.lower()), set())
        if d in own:
            out[(p, d, t)] = "existing"
            continue
        want = own | {d}
        clash = any(
            q == p and o != t.lower() and (o in t.lower() or t.lower() in o) and want != had
            for (q, o), had in types.items()
        )
        out[(p, d, t)] = "rejected" if clash else "added"
        if not clash:
            types.setdefault((p, t.lower()), set()).add(d)
    return out


def test_merge_equals_one_by_one_admission(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "bc", "bcd", "abcd", "xy", "xyz", "yz", "zab", "cd"]
    base = [("p", "PHONE", "abc"), ("p", "SMS", "xy"), ("q", "SMS", "ab")]
    names = rng.sample([(p, d, w) for p in "pq" for d in ("PHONE", "SMS", "NAME") for w in words], 24)
    cand = [(p, d, w, i) for i, (p, d, w) in enumerate(names)]
    want = greedy_merge(base, cand)
    merged = catalog.merge_catalog(
        spark.createDataFrame(base, "platform string, data_type string, token string"),
        spark.createDataFrame(cand, "platform string, data_type string, token string, rank long"),
    )
    got = {(r.platform, r.data_type, r.token): r.status for r in merged.collect() if r.status != "base"}
    assert {k: v for k, v in got.items() if v != "existing"} == {
        k: v for k, v in want.items() if v != "existing"
    }


def best_key(hidden):
    """Every key in turn; the first with the most word pieces wins."""
    best, score = None, 0
    for key in range(1, 256):
        plain = bytes(b ^ key for b in hidden.encode("latin-1")).decode("utf-8", "ignore")
        shown = sum(c.isprintable() or c in "\r\n\t" for c in plain) / max(len(plain), 1)
        if len(plain) < 8 or shown < 0.9 or not re.search("[A-Za-z]", plain):
            continue
        pieces = len(re.findall("[A-Za-z]{3,}", plain))
        if pieces > score:
            best, score = plain, pieces
    return best if score >= 3 else None


def test_key_search_equals_trying_every_key(spark):
    phrases = ["send the device now to them", "a b c at the big old token", "xy"]
    hidden = ["".join(chr(ord(c) ^ 0x75) for c in p) for p in phrases]
    df = spark.createDataFrame([(h,) for h in hidden], "token string")
    got = {r.token: r.xor_plain for r in restore.xor_key_search(df).collect()}
    assert got[hidden[2]] is None
    assert all(got[h] == best_key(h) for h in hidden[:2])


def test_restored_text_needs_no_id(spark):
    """Rows with equal or NULL ids keep their own texts, and NULL stays NULL."""
    texts = ["[platform=ios]\nstack: a.B.c\nparams: {\"k\": \"granted\"}", "x\u200by other", None, ""]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[0]), (None, texts[1]), (2, texts[2]), (2, texts[3])]
    out = restore.restore_text(spark.createDataFrame(rows, "id long, text string")).collect()
    want = {texts[0]: texts[0], texts[1]: "xy other", None: None, "": ""}
    assert len(out) == len(rows) and all(r.normalized == want[r.text] for r in out)


def test_scrubbed_lists_and_objects_keep_their_items(spark):
    body = '{"a": ["PHONE", "13800138000", 5, null, {"b": true}], "phone": true, "o": {"x": [], "y": {}}}'
    (row,) = scan.scrub_params(spark.createDataFrame([(body,)], "body string")).collect()
    assert re.sub("sha1=[0-9a-f]+", "sha1=", row.scrubbed) == (
        '{"a": ["PHONE", "<redacted:len=11:sha1=>", 5, null, {"b": true}], "phone": "<redacted:len=4:sha1=>", "o": {"x": [], "y": {}}}'
    )
