"""String columns: normalisation, guards, scrubbing and scanning."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.functions import patterns as P
from callwarden.functions.consts import const, known, strings
from callwarden.functions.decode import digit_table

# --- fixed values: words of code and of the value enumerations -----------------------
CODE_WORDS = """
get set send handle request response dispatch query fetch load save init create start stop
open close read write check verify update delete insert add remove register unregister bind
connect disconnect call exec run process parse format encode decode encrypt decrypt sign login
logout location manager device camera account contact record activity service client provider
store session token user phone sms message calllog file image photo media audio video network
wifi bluetooth telephony settings secure content observer listener callback handler adapter
helper bridge impl factory builder config info data result error event state status action
intent bundle context view page app core sdk api system permission privacy consent policy auth
credential identify advertise os ui util on click did view appear disappear submit tap
analytics statistics stats map push pay payment vendor novel away geo extra torch pearl river
group soft base pro kit cloud function bank card face finger print biometric scan mail inbox
compose health walk run recognizer reader tracker observe notify sync cache remote local proxy
"""
ENUM_WORDS = """
granted denied revoked withdrawn not_asked unknown absent masked raw partial self third_party
minimal all https http true false none AES-256-GCM TLS1.3 SM4-GCM RSA-OAEP ChaCha20-Poly1305
DES-ECB AES-ECB core_function account_security verification identity_verification payment
analytics security notification profile content_publish health_service navigation weather
social backup video_call ad_recommend marketing performance user_profiling arbitrary_extend
PHONE ID_CARD BANK_CARD DEVICE_ID EMAIL NAME EXACT_IMAGE HEALTH LOCATION SMS CONTACTS BIOMETRIC
CAMERA_MIC NONE
"""
SUBWORD = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[a-z]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, P.ZERO_WIDTH, "")


def strip_unicode_tags(c: Column) -> Column:
    return F.regexp_replace(c, P.TAG_CHARS, "")


def fold_confusables(c: Column) -> Column:
    return F.translate(c, P.CONFUSABLE_FROM, P.CONFUSABLE_TO)


def fold_digits(c: Column) -> Column:
    """Single-digit numerals of any script to ASCII, by one generated table."""
    table = digit_table()
    return F.translate(c, "".join(table), "".join(table.values()))


def collapse_digit_separators(c: Column) -> Column:
    return F.regexp_replace(c, P.DIGIT_GAP, "")


def join_string_concat(c: Column) -> Column:
    """``"a"+"b"`` becomes ``"ab"``; a single literal loses its quotes."""
    joined = F.regexp_replace(c, r'(?<=")([^"]*)"\s*\+\s*"', "$1")
    whole = F.regexp_extract(joined, r'^"([^"]*)"$', 1)
    return F.when(joined == c, c).when(joined.rlike(r'^"[^"]*"$'), whole).otherwise(joined)


def canonicalize_enum(c: Column) -> Column:
    """Known enumeration value in its canonical spelling; other text stays."""
    words: dict[str, str] = {}
    for word in ENUM_WORDS.split():
        words.setdefault(word.lower(), word)
    known = F.try_element_at(const(words, "map<string,string>"), F.lower(c))
    return F.when(F.length(c) <= 40, F.coalesce(known, c)).otherwise(c)


def code_subwords(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(SUBWORD), F.lit(0)), F.lower)


def code_score(c: Column) -> Column:
    """Number of sub-words that are words of code."""
    words = strings(sorted(set(CODE_WORDS.split())))
    return F.size(F.filter(code_subwords(c), lambda w: F.array_contains(words, w)))


def rot13(c: Column) -> Column:
    turned = LETTERS[13:26] + LETTERS[:13] + LETTERS[39:] + LETTERS[26:39]
    return F.translate(c, LETTERS, turned)


def rot13_if_code(c: Column) -> Column:
    """Undo ROT13 where that yields an enumeration value or words of code."""
    turned = rot13(c)
    canon = canonicalize_enum(turned)
    eligible = (F.length(c) >= 3) & c.rlike("[A-Za-z]{2,}") & (code_score(c) == 0)
    is_enum = F.lower(turned).isin([w.lower() for w in ENUM_WORDS.split()])
    return (
        F.when(eligible & is_enum, canon)
        .when(eligible & (F.length(c) >= 6) & (code_score(turned) >= 1), turned)
        .otherwise(c)
    )


def printable_ratio(c: Column) -> Column:
    """Share of characters that are printable or line breaks and tabs."""
    shown = F.length(F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}&&[^\r\n\t]]", ""))
    return F.when(F.length(c) > 0, shown / F.length(c)).otherwise(F.lit(0.0))


def plausible_text(c: Column, least: int = 4) -> Column:
    return (
        (F.length(c) >= least) & (printable_ratio(c) >= 0.9) & c.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")
    )


# --- input guard ---------------------------------------------------------------------
def has_bare_b64(c: Column) -> Column:
    """A long base64-looking token, not merely a long identifier."""
    tokens = F.regexp_extract_all(c, F.lit("(?U)" + P.BARE_BASE64), F.lit(0))
    telling = F.exists(
        tokens,
        lambda t: t.rlike(r"[+/]|=$") | (t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]")),
    )
    return c.rlike(P.BASE64_RUN) & c.rlike("(?U)" + P.BARE_BASE64) & telling


def residual_token(c: Column) -> Column:
    """A marked token; the pattern runs only over texts that hold one of its marks."""
    marked = reduce(or_, [c.contains(mark) for mark in P.RESIDUAL_MARKS])
    return marked & c.rlike(P.RESIDUAL_TOKEN)


def residue_to_restore(c: Column) -> Column:
    """``guard_action`` would be 'preprocess': only texts with characters beyond ASCII are looked at.

    Nothing stands in it twice: common parts are computed first, for all texts.
    """
    harmless = (
        (F.translate(c, P.ZERO_WIDTH, "") != c) | c.rlike(P.TAG_CHARS) | (F.translate(c, P.CONFUSABLE_FROM, P.CONFUSABLE_TO) != c)
    )
    return (F.octet_length(c) != F.length(c)) & harmless & ~(residual_token(c) | has_bare_b64(c))


def guard_residual(c: Column) -> Column:
    """Kinds of residue left by an unfinished de-obfuscation."""
    foreign = F.octet_length(c) != F.length(c)  # the first three are kinds of characters beyond ASCII
    marks = known(
        F.when(foreign & (F.translate(c, P.ZERO_WIDTH, "") != c), "zero_width"),
        F.when(foreign & c.rlike(P.TAG_CHARS), "unicode_tag"),
        F.when(foreign & (F.translate(c, P.CONFUSABLE_FROM, P.CONFUSABLE_TO) != c), "confusable"),
        F.when(residual_token(c) | has_bare_b64(c), "encoded_token"),
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(
        marks
    )


def guard_action(residual: Column) -> Column:
    stop = F.arrays_overlap(residual, F.array(F.lit("encoded_token"), F.lit("empty")))
    return F.when(stop, "review").when(F.size(residual) > 0, "preprocess").otherwise("pass")


# --- scrubbing -------------------------------------------------------------------------
def scrub_external(c: Column) -> Column:
    """Masking before text may leave the house; eight rules in order."""
    for pattern, mask in P.EXTERNAL_RULES:
        c = F.regexp_replace(c, "(?U)" + pattern, mask)
    return c


def looks_like_blob(s: Column, least: int = 20) -> Column:
    """Encoded data or a key, judged by structure; long identifiers are none."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (
        (F.length(s) >= least)
        & s.rlike("^[A-Za-z0-9+/=_-]+$")
        & (
            s.rlike("^[0-9]+$")
            | s.rlike("[=+]")
            | s.rlike("^[0-9a-fA-F]{32,}$")
            | s.startswith("eyJ")
            | (digits / F.length(s) >= 0.10)
        )
    )


def digest(s: Column) -> Column:
    return F.substring(F.sha1(s), 1, 10)


def mask_blobs(c: Column) -> Column:
    """Replace blobs by length and digest, keeping everything around them."""
    blobs = F.regexp_extract_all(c, F.lit(P.BLOB), F.lit(0))
    gaps = F.split(c, P.BLOB)
    shown = F.transform(
        blobs,
        lambda b: F.when(
            looks_like_blob(b),
            F.concat(F.lit("<blob:"), F.length(b).cast("string"), F.lit(":"), digest(b), F.lit(">")),
        ).otherwise(b),
    )
    pieces = F.zip_with(
        gaps, shown, lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))
    )
    return F.when(F.size(blobs) > 0, F.array_join(pieces, "")).otherwise(c)


def scrub_str(c: Column, cap: int | None = None) -> Column:
    """Nine rules in order, then blobs, then a truncation note."""
    out = c
    for _, pattern, mask in P.LOG_RULES:
        out = F.regexp_replace(out, "(?U)" + pattern, mask)
    out = mask_blobs(out)
    if cap is None:
        return out
    note = F.concat(F.lit("…<trunc:"), F.length(c).cast("string"), F.lit(">"))
    return F.when(F.length(out) > cap, F.concat(F.substring(out, 1, cap), note)).otherwise(out)


def redacted(v: Column) -> Column:
    return F.concat(
        F.lit("<redacted:len="), F.length(v).cast("string"), F.lit(":sha1="), digest(v), F.lit(">")
    )


def scrub_value(v: Column) -> Column:
    """A short clean string stays, any other string is redacted."""
    keep = (
        v.rlike(P.KEPT_VALUE) & ~v.rlike("[0-9]{6,}") & ~looks_like_blob(v, 16)
    )
    return F.when(keep, scrub_str(v, 120)).otherwise(redacted(v))


def scan_rules() -> list[tuple[str, str]]:
    """(rule, pattern) of the self-check for personal data left in text."""
    return [(name, pattern) for name, pattern, _ in P.LOG_RULES] + [("blob", P.SCAN_BLOB)]
