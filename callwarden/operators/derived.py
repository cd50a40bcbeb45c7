"""Call tables derived from other tables, for runs without hook logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.functions.consts import per_session, strings
from callwarden.operators.staging import seal

# --- fixed values: one catalogue token per platform and type ---------------------
TYPES = (
    "PHONE|ID_CARD|BANK_CARD|DEVICE_ID|EMAIL|NAME|EXACT_IMAGE|HEALTH|LOCATION|SMS|CONTACTS|"
    "BIOMETRIC|CAMERA_MIC"
)
TOKENS = {
    "android": "TelephonyManager.getLine1Number|IdCardRecognizer.recognize|BankCardRecognizer.recognize|TelephonyManager.getImei|AccountManager.getAccountsByType|ContactsContract.Profile.CONTENT_URI|ImageCapture.takePicture|HealthConnectClient.readRecords|LocationManager.getLastKnownLocation|SmsManager.sendMultipartTextMessage|ContactsContract.Contacts.CONTENT_URI|BiometricPrompt.authenticate|CameraManager.openCamera",
    "ios": "CTTelephonyNetworkInfo subscriberCellularProvider|VNRecognizeTextRequest perform|CardRecognizer recognizeCard|ASIdentifierManager advertisingIdentifier|MailManager fetchInboxMessages|CNContactStore unifiedContacts|PHPickerViewController didFinishPicking|HKHealthStore executeQuery|CLLocationManager requestLocation|CTMessageCenter interactiveMessage|CNContactStore requestAccess|LAContext evaluatePolicy|AVCaptureSession startRunning",
    "miniprogram": "wx.getPhoneNumber|OCRPlugin.recognizeIdCard|CloudFunction.verifyBankCard|wx.getDeviceInfo|CloudFunction.syncMailbox|wx.getUserProfile|wx.chooseImage|wx.getWeRunData|wx.getLocation|CloudFunction.readSmsVerify|wx.chooseContact|wx.startFacialRecognitionVerify|wx.startRecord",
    "harmony": "sim.getSimTelephoneNumber|OCR.recognizeIdCard|payment.queryBankCardInfo|identifier.getOAID|MailService.queryInbox|osAccount.queryOsAccount|PhotoAccessHelper.getAssets|healthService.queryLatestHealthData|geoLocationManager.getLastLocation|sms.getAllSimMessages|contact.queryContactByKey|userAuth.auth|AudioCapturer.start",
}


def h(i: int) -> Column:
    return F.pmod(
        F.col("event_id") * (7919 + 6151 * i)
        + F.col("user_id") * (31 + 17 * i)
        + F.col("k") * (104729 + 7907 * i),
        F.lit(1000003),
    )


def pick(items: str, i: int) -> Column:
    values = items.split("|")
    return F.get(strings(values), (h(i) % len(values)).cast("int"))


@per_session
def _call_columns() -> tuple:
    """(platform, true type, token, halves of the parameters, text) of the call made from one event."""
    token = F.when(F.lit(False), F.lit(""))
    for platform, items in TOKENS.items():
        token = token.when(F.col("platform_true") == platform, pick(items, 1))
    dotted = F.translate("token", " ", ".")
    mode = h(2) % 10
    frame = (
        F.when(mode <= 5, F.col("token"))
        .when(mode == 6, F.concat(F.lit("a.b."), F.substring_index(dotted, ".", -1)))
        .when(
            mode == 7,
            F.concat(F.lit("com.vendor."), F.substring_index(dotted, ".", 1), F.lit(".a")),
        )
        .when(mode == 8, "a.b")
        .otherwise("com.vendor.map.Tile.draw")
    )

    def text_field(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": "'), value, F.lit('"'))

    state, scope, told = h(3) % 10, h(4) % 20, h(5) % 12
    crypto, mask, dest = h(6) % 10, h(8) % 9, h(14) % 6
    purposes = (
        "core_function|account_security|verification|identity_verification|payment|analytics|"
        "security|health_service|social|marketing"
    )
    fields = [
        text_field(
            "consent_state",
            F.when(state <= 6, "granted").when(state == 7, "denied").when(state == 8, "revoked"),
        ),
        F.when(scope == 1, '"consent_scope": []')
        .when(scope == 2, '"consent_scope": ["NAME"]')
        .when(scope > 2, F.concat(F.lit('"consent_scope": ["'), F.col("true_dt"), F.lit('"]'))),
        F.when(told == 0, '"policy_disclosed": false').when(told > 1, '"policy_disclosed": true'),
        text_field(
            "crypto",
            F.when(crypto == 0, pick("none|raw|DES-ECB|AES-ECB", 7)).when(
                crypto > 1, pick("AES-256-GCM|TLS1.3|SM4-GCM", 7)
            ),
        ),
        text_field(
            "pii_mask",
            F.when(mask == 0, "raw").when(mask <= 2, "partial").when(mask > 3, "masked"),
        ),
        F.when(h(9) % 3 == 0, text_field("biz_purpose", pick(purposes, 10))),
        text_field(
            "collect_scope",
            F.when(h(11) % 15 == 0, "all").when((h(11) % 15).between(1, 4), "minimal"),
        ),
        F.when(
            h(12) % 4 == 0,
            F.concat(F.lit('"retention_days": '), (h(13) % 730).cast("string")),
        ),
        text_field(
            "data_destination", F.when(dest == 0, "third_party").when(dest <= 2, "self")
        ),
        F.when(h(15) % 3 == 0, '"separate_consent": false'),
    ]
    text = F.concat(
        F.lit("[platform="),
        F.col("platform_true"),
        F.lit("]\nstack: com.app.u"),
        (F.col("user_id") % 9 + 1).cast("string"),
        F.lit(".Ui.onClick <- "),
        frame,
        F.lit("(F.java:"),
        (F.col("event_id") % 900).cast("string"),
        F.lit(")\nparams: {"),
        F.concat_ws(", ", "_params0", "_params1"),
        F.lit("}"),
    )
    params = [F.nullif(F.concat_ws(", ", *half), F.lit("")) for half in (fields[:5], fields[5:])]
    return pick("android|ios|miniprogram|harmony", 0), pick(TYPES, 1), token, params, text


def hook_calls(events: DataFrame) -> DataFrame:
    """One call per event: id, pos, text and the truth columns (data_type, violation inputs)."""
    platform, true_dt, token, params, text = _call_columns()
    df = events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
    df = df.withColumns({"platform_true": platform, "true_dt": true_dt})
    df = df.withColumn("token", token)
    for i, half in enumerate(params):  # compiled apart: a method of all is too long and gets interpreted
        df = seal(df.withColumn(f"_params{i}", half), f"_params{i}")
    df = df.select(
        F.col("event_id").alias("id"),
        "ts",
        "user_id",
        "event_type",
        "value",
        text.alias("text"),
        "true_dt",
        "token",
    )
    return seal(df, "text", "true_dt", "token")


def document_calls(documents: DataFrame) -> DataFrame:
    """One declared-empty call per document, carrying the whole text under a neutral key."""
    df = documents.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("doc_text"),
        F.concat(
            F.lit("[platform=android]\nstack: com.cloud.bridge.Sync.pull(X.kt:"),
            (F.col("doc_id") % 97).cast("string"),
            F.lit(")\nparams: "),
            F.to_json(
                F.struct(
                    F.array().cast("array<string>").alias("consent_scope"),
                    F.col("text").alias("note"),
                )
            ),
        ).alias("text"),
    )
    return seal(df, "text")
