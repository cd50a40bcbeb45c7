"""Patterns and character tables shared by the text operators; all fixed values."""

from __future__ import annotations

# --- fixed values: invisible characters and look-alikes ---------------------------
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e"
TAG_CHARS = r"[\x{E0000}-\x{E007F}]"
CONFUSABLE_FROM = "аеорсхуіѕԁкмнтвАЕОРСХУІЅКМНТВοαερτινκμχγΟΑΕΡΤΙΚΜΧ‐‑‒–—．․・"
CONFUSABLE_TO = "aeopcxyisdkmhtbAEOPCXYISKMHTBoaeptivkuxyOAEPTIKMX-----..."

# --- fixed values: personal-data shapes ------------------------------------------
MOBILE = r"(?:0086|00|86|0)?0*1[3-9]\d{9}"
COORD_DEC = r"-?\d{1,3}\.\d{2,}\s*(?:°\s*)?[NSEWnsew]?"
COORD_DMS = r"-?\d{1,3}\s*°\s*\d{1,2}(?:\.\d+)?\s*['′]\s*\d{1,2}(?:\.\d+)?\s*[\"″]?\s*[NSEWnsew]?"
COORD_PAIR = rf"(?:{COORD_DEC}|{COORD_DMS})\s*[,;|/]\s*(?:{COORD_DEC}|{COORD_DMS})"
COORD_ONE = r"-?\d{1,3}(?:\.\d+)?\s*°\s*(?:\d{1,2}(?:\.\d+)?\s*['′]\s*\d{1,2}(?:\.\d+)?\s*[\"″]?\s*)?[NSEWnsew]?"
WHOLE_SHAPES = [
    ("email", r"^[\w.+-]+@[\w-]+\.[\w.]{2,}$"),
    ("coord", rf"^{COORD_PAIR}$"),
    ("coord1", rf"^{COORD_ONE}$"),
    ("opaque", r"^[A-Za-z0-9+/=_-]{32,}$"),
]
OPAQUE_EXEMPT = (
    r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
)
DIGIT_SHAPES = [
    ("mobile", rf"^{MOBILE}$"),
    ("idcard", r"^(?:\d{17}[\dXx]|\d{15})$"),
    ("bankcard", r"^\d{16,19}$"),
]
EMBEDDED_SHAPES = [
    ("mobile", rf"(?<!\d){MOBILE}(?!\d)"),
    ("idcard", r"(?<!\d)\d{17}[\dXx](?![\dXx])"),
    ("bankcard", r"(?<!\d)\d{16,19}(?!\d)"),
    ("email", r'[\w.+\-"]@(?:[\w-]+\.[\w.-]{2}|[\w.-]{512})'),
    ("coord", rf"(?<![\d.]){COORD_PAIR}(?![\d.])"),
    ("coord1", rf"(?<![\d.]){COORD_ONE}(?![\d.])"),
]
MAX_AT_SIGNS = 256
DIGIT_GAP = "(?<=[0-9])[ \\t\u00a0\u3000._/|·•‧∙‣⁃,\\-\u2010-\u2015\u2212]+(?=[0-9])"

# --- fixed values: obfuscation and residual encodings ------------------------------
SHORT_CALL = (
    r"(?<![a-z0-9])[a-z][a-z0-9]?\.[a-z][a-z0-9]?(?=\s*\()"
    r"|-\[\s*[a-z]{1,2}\s+[a-z][a-z0-9]?\s*\]"
)
IDENTIFIER = r"[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*"
RESIDUAL_TOKEN = (
    r"sf:[A-Za-z0-9+/=]{8,}:[A-Za-z0-9+/=]{8,}|b64:[A-Za-z0-9+/=_-]{8,}"
    r"|base64:[A-Za-z0-9+/=_-]{8,}|0x[0-9a-fA-F]{24,}|(?:\\u[0-9a-fA-F]{4}){6,}"
    r"|(?:%[0-9a-fA-F]{2}){8,}"
)
#: Every residual token holds one of these.
RESIDUAL_MARKS = ("sf:", "b64:", "base64:", "0x", "\\u", "%")
SUSPECTED_TOKEN = r"sf:[A-Za-z0-9+/=]{16,}|b64:[A-Za-z0-9+/=]{16,}|0x[0-9a-fA-F]{32,}"
#: Every bare base64 token holds such a run.
BASE64_RUN = r"(?<![\p{Alnum}+/])[\p{Alnum}+/]{40}"
BARE_BASE64 = r"(?<![\w+/=])[A-Za-z0-9+/]{40,}={0,2}(?![\w+/=])"

# --- fixed values: scrub rules, in order --------------------------------------------
SECRET_KEY = r"(?i)\b(?:sk|ak|pk|ghp|xox[baprs])[-_][A-Za-z0-9_\-]{16,}"
CREDENTIAL = r"(?i)\b(token|access_token|sessionid|authorization)\s*[=:]\s*[^\s,}\"]+"
URL = r"https?://[^\s\"']+"
LOG_RULES = [
    ("mobile", r"(?<!\d)1[3-9]\d{9}(?!\d)", "<PHONE>"),
    ("idcard", r"(?<!\d)\d{17}[\dXx](?!\d)", "<IDCARD>"),
    ("bankcard", r"(?<!\d)\d{16,19}(?!\d)", "<BANKCARD>"),
    ("email", r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9][\w-]*\.[A-Za-z]{2,}", "<EMAIL>"),
    ("geo", r"(?<!\d)\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}(?!\d)", "<GEO>"),
    ("secret", SECRET_KEY, "<KEY>"),
    ("credential", CREDENTIAL, "$1=<REDACTED>"),
    ("url", URL, "<URL>"),
    ("long_number", r"(?<!\d)\d{20,}(?!\d)", "<LONGNUM>"),
]
EXTERNAL_RULES = [
    (r"1[3-9]\d{9}", "<PHONE>"),
    (r"\b\d{17}[\dXx]\b", "<IDCARD>"),
    (r"\b\d{16,19}\b", "<BANKCARD>"),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "<EMAIL>"),
    (r"\b\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}\b", "<GEO>"),
    (SECRET_KEY, "<KEY>"),
    (CREDENTIAL, "$1=<REDACTED>"),
    (URL, "<URL>"),
]
BLOB = r"[A-Za-z0-9+/=_-]{20,}"
SCAN_BLOB = r"[A-Za-z0-9+/=]{24,}"
SENSITIVE_KEY = (
    r"(?i)(phone|mobile|tel|idcard|id_card|card|bank|email|mail|addr|address|lat|lng|lon|gps|geo"
    r"|token|secret|password|passwd|pwd|key|session|imei|imsi|mac|oaid|aaid|idfa|androidid"
    r"|openid|unionid|uid|userid|user_id)"
)
KEPT_VALUE = r'^[A-Za-z0-9_\-\.\[\]{}"]{0,24}$'
