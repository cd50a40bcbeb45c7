"""Column expressions over the text of one captured call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden import vocab

BLANK = " \t\n\r\f\u000b"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def platform_tag(text: Column) -> Column:
    """Declared platform, NULL when the tag is missing."""
    return blank_to_null(F.regexp_extract(text, r"(?U)\[platform=(\w+)\]", 1))


def platform_infer(text: Column) -> Column:
    """Platform guessed from the shape of stack frames, first matching rule."""
    return (
        F.when(text.rlike(r"(?U)-\[[A-Z]\w+ [\w:]+\]"), "ios")
        .when(text.rlike(r"(?U)wx\.\w+"), "miniprogram")
        .when(text.rlike(r"(?i)@?ohos\.") | text.contains(".ets:"), "harmony")
        .when(text.rlike(r"(?i)(android|\.java:)"), "android")
    )


def platform_effective(text: Column) -> Column:
    """Platform to search; NULL means every platform."""
    found = F.coalesce(platform_tag(text), platform_infer(text))
    return F.when(found.isin(vocab.PLATFORMS), found)


def segments(text: Column) -> Column:
    """Struct (stack, body) cut at the first parameter header."""
    cut = F.split(text, r"(?iU)params\s*:\s*", 2)
    return F.struct(
        F.get(cut, F.lit(0)).alias("stack"),
        F.btrim(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), F.lit(BLANK)).alias("body"),
    )


def stack_frames(stack: Column) -> Column:
    """Frames, outermost first."""
    trimmed = F.regexp_replace(stack, r"(?s)^.*?stack\s*:\s*|\s+$", "")
    return F.split(trimmed, " <- ")


def frame_api(text: Column) -> Column:
    """Label of the called API: declared name, bare first key, or first frame."""
    declared = F.regexp_extract(text, r'(?U)"(?:_api|api)"\s*:\s*"([^"]{1,80})"', 1)
    bare = F.regexp_extract(text, r"(?U)params:\s*\{\s*([A-Za-z0-9_\.\$\[\]]{1,80})\s*:", 1)
    frame = F.regexp_extract(text, r"(?U)stack:\s*([^<\n]{1,80})", 1)
    return F.coalesce(
        blank_to_null(declared),
        blank_to_null(bare),
        F.when(
            text.rlike(r"(?U)stack:\s*[^<\n]"), F.substring(F.btrim(frame, F.lit(BLANK)), 1, 80)
        ),
    )


def input_digest(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, size)


def declaration_fingerprint(text: Column, body: Column) -> Column:
    """Shape of a declaration: platform, emptiness, key names; never values."""
    tag = F.lower(F.regexp_extract(text, r"(?iU)\[platform=(\w+)\]", 1))
    empty = text.rlike(r'(?iU)"consent_scope"\s*:\s*\[\s*\]')
    keys = F.sort_array(
        F.array_distinct(F.regexp_extract_all(body, F.lit(r'(?U)"([^"]+)"\s*:'), F.lit(1)))
    )
    return F.concat(
        F.when(tag == "", F.lit("?")).otherwise(tag),
        F.when(empty, F.lit("|empty=1|")).otherwise(F.lit("|empty=0|")),
        F.array_join(keys, ","),
    )


def build_combo(data_type: Column, violation: Column) -> Column:
    """Valid pair, else the type's COMPLIANT pair, else NONE."""
    known_type = data_type.isin(vocab.PERSONAL_TYPES)
    return (
        F.when(known_type & violation.isin(vocab.VIOLATIONS), F.concat_ws("||", data_type, violation))
        .when(known_type, F.concat(data_type, F.lit("||COMPLIANT")))
        .otherwise("NONE||COMPLIANT")
    )


def split_combo(combo: Column) -> Column:
    parts = F.split(combo, r"\|\|")
    return F.struct(parts[0].alias("data_type"), parts[1].alias("violation"))


def severity(violation: Column) -> Column:
    """Rank, 0 = gravest; COMPLIANT and unknown values are lightest."""
    order = vocab.SEVERITY_ORDER[:-1]
    rank = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(order):
        rank = rank.when(violation == v, F.lit(i))
    return rank.otherwise(F.lit(len(vocab.SEVERITY_ORDER)))
