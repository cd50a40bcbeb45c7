"""Reversible codecs and character folding as column expressions; nothing here leaves the JVM.

A codec takes a text column and gives the printable text it stands for, else NULL. Radix codecs go through
bit strings or group values; the byte string is checked as UTF-8 before it counts. Folding is one
table look-up a character, built from the Unicode data by rule.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from functools import cache
from html.entities import html5

from callwarden.functions import sqlx as F
from callwarden.functions.sqlx import E as Column
from callwarden.functions.sqlx import const

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Alphabets of the two radix-85 forms: digits, letters and marks; or the 85 characters from "!" on.
RADIX85 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
ASCII85 = "".join(map(chr, range(33, 118)))
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
ASCII_ONLY = r"^[\x00-\x7f]*$"

# --- fixed values: CJK numerals --------------------------------------------------
CJK_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
              "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
CJK_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
CJK_MYRIADS = {"万": 10_000, "萬": 10_000, "亿": 100_000_000, "億": 100_000_000}
INVISIBLE = "​‌‍⁠﻿­"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(function):
    """Compute a function's first argument once, however often its expression names it."""

    @functools.wraps(function)
    def once(c, *args, **kwargs):
        return let(c, lambda x: function(x, *args, **kwargs))

    return once


@bound
def replaced(c: Column, pattern: str, shown: Callable[[Column], Column]) -> Column:
    """``c`` with every match of ``pattern`` replaced by a function of it."""
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, F.transform(found, shown), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(pieces, "")).otherwise(c)


def printable(c: Column) -> Column:
    # one class, no group: a repeated group of choices takes stack for each character
    return c.rlike(r"^[ [^\p{C}\p{Z}]]+$")


def shown(raw: Column) -> Column:
    """Bytes as text, if they are UTF-8 and printable."""
    return let(F.try_validate_utf8(raw.cast("string")), lambda t: F.when(printable(t), t))


# ---------------------------------------------------------------- code points and escapes


def code_point(number: Column) -> Column:
    """Character of a code point; ``?`` for surrogates, NULL beyond the last one."""
    wide = F.lpad(F.hex(number.cast("long")), 8, "0")
    inside = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(inside, F.decode(F.unhex(F.when(inside, wide)), "UTF-32")).when(number.between(0xD800, 0xDFFF), "?")


def _escape(c: Column, pattern: str, skip: int, base: int) -> Column:
    number = lambda m: F.conv(F.substr(m, F.lit(skip + 1)), base, 10).cast("long")
    return replaced(c, pattern, lambda m: F.coalesce(code_point(number(m)), m))


@bound
def unescape(c: Column) -> Column:
    """Literal ``\\uXXXX`` and ``\\xXX`` to characters."""
    plain = _escape(_escape(c, r"\\u[0-9a-fA-F]{4}", 2, 16), r"\\x[0-9a-fA-F]{2}", 2, 16)
    return F.when(F.contains(c, F.lit("\\")), plain).otherwise(c)


@bound
def escapes(c: Column) -> Column:
    """All escapes of source code: ``\\uXXXX``, ``\\UXXXXXXXX``, ``\\xXX`` and octal."""
    wide = _escape(_escape(c, r"\\u[0-9a-fA-F]{4}", 2, 16), r"\\U[0-9a-fA-F]{8}", 2, 16)
    plain = _escape(_escape(wide, r"\\x[0-9a-fA-F]{2}", 2, 16), r"\\[0-7]{3}", 1, 8)
    return F.when(F.contains(c, F.lit("\\")), plain).otherwise(c)


@cache
def _numeric_entities() -> dict[str, str]:
    """Replacements the HTML standard asks for: 0x80 to 0x9F as in Windows-1252, 0 and 13."""
    table = {"0": "�", "13": "\r"}
    for number in range(0x80, 0xA0):
        table[str(number)] = bytes([number]).decode("cp1252", "ignore") or chr(number)
    return table


@bound
def _entity(m: Column) -> Column:
    body = F.regexp_replace(m, "^&|;$", "")
    digits = F.regexp_replace(body, "^#[xX]?", "")
    number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    value = number.try_cast("decimal(38,0)").try_cast("long")
    # characters that are none: controls and the last two of each plane
    none = value.between(1, 8) | value.between(14, 31) | value.isin(11, 127) | value.between(0xFDD0, 0xFDEF) | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    known = F.try_element_at(const(_numeric_entities(), "map<string,string>"), value.cast("string"))
    point = F.when(value.between(0xD800, 0xDFFF), "�").otherwise(code_point(value))
    numeric = F.coalesce(known, F.when(none & (value <= 0x10FFFF), ""), point, F.lit("�"))
    names = const(html5, "map<string,string>")
    name = F.substr(m, F.lit(2))
    ends = F.reverse(F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))))
    prefixes = F.filter(F.transform(ends, lambda n: F.concat(F.try_element_at(names, F.substr(name, F.lit(1), n)), F.substr(name, n + 1))), lambda t: t.isNotNull())
    return F.when(body.startswith("#"), numeric).otherwise(F.coalesce(F.get(prefixes, F.lit(0)), m))


@bound
def html_text(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("&")), replaced(c, ENTITY, _entity)).otherwise(c)


@bound
def url_text(c: Column) -> Column:
    """Percent escapes to characters; ``+`` stays and malformed escapes stay."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(c.rlike("%[0-9a-fA-F]{2}"), F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


# ---------------------------------------------------------------- radix codecs


@bound
def base64_bytes(packed: Column) -> Column:
    """Bytes of standard or URL-safe base64; padding may be short, but not superfluous."""

    def decoded(core: Column) -> Column:
        need, given = F.pmod(-F.length(core), F.lit(4)), F.length(packed) - F.length(core)
        fits = (need != 3) & (given <= need)
        return F.when(fits, F.try_to_binary(F.when(fits, F.concat(core, F.repeat(F.lit("="), need))), F.lit("base64")))

    standard = F.when(packed.rlike("[-_]"), F.translate(packed, "-_", "+/")).otherwise(packed)
    return F.when(packed.rlike(r"^[A-Za-z0-9+/_-]+={0,2}$"), let(F.rtrim(standard, "="), decoded))


@bound
def _from_bits(bits: Column) -> Column:
    """Bytes of a string of 0 and 1; bits beyond the last whole byte are dropped."""
    pairs = F.transform(F.regexp_extract_all(bits, ".{8}", 0), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0"))
    return F.when(F.length(bits) >= 8, F.unhex(F.array_join(pairs, "")))


@bound
def base32_bytes(packed: Column) -> Column:
    core = F.upper(F.replace(packed, F.lit("="), F.lit("")))
    bit = lambda c: F.lpad(F.bin(F.position(c, F.lit(BASE32)) - 1), 5, "0")
    fits = core.rlike("^[A-Z2-7]+$") & (F.length(core) % 8).isin(0, 2, 4, 5, 7)
    return F.when(fits, _from_bits(F.array_join(F.transform(F.split(core, ""), bit), "")))


@bound
def hex_bytes(c: Column) -> Column:
    pairs = F.regexp_replace(F.regexp_replace(c, "^0[xX]", ""), r"[:\s\-]", "")
    return let(pairs, lambda p: F.when(p.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(p)))


@cache
def _text_of_85(alphabet: str) -> str:
    """Pattern of the first two characters of radix-85 text that may stand for printable text.

    They settle the first byte but for a carry; it must be no control and may begin a character of UTF-8.
    """
    def may_begin(a: int, b: int) -> bool:
        low = (a * 85 + b) * 85**3
        return any(0x20 <= byte <= 0x7E or 0xC2 <= byte <= 0xF4 for byte in (low >> 24, (low + 85**3 - 1) >> 24))

    seconds: dict[str, list[str]] = {}
    for a, first in enumerate(alphabet):
        allowed = "".join("\\" + c if not c.isalnum() else c for b, c in enumerate(alphabet) if may_begin(a, b))
        if allowed:
            seconds.setdefault(allowed, []).append("\\" + first if not first.isalnum() else first)
    return "^(?:" + "|".join(f"[{''.join(firsts)}][{allowed}]" for allowed, firsts in seconds.items()) + ")"


@bound
def _groups_of_five(c: Column, alphabet: str) -> Column:
    """Bytes of radix-85 text: five characters are four bytes, the last group may be short.

    NULL also for bytes that are no printable text for certain.
    """
    lack = F.pmod(-F.length(c), F.lit(5))
    full = F.concat(c, F.repeat(F.lit(alphabet[-1]), lack))
    count = (F.length(full) / 5).cast("int")

    def value(five: Column) -> Column:
        place = lambda k: F.position(F.substr(five, F.lit(k), F.lit(1)), F.lit(alphabet)) - 1
        number = place(1).cast("long")
        for k in range(2, 6):
            number = number * 85 + place(k)
        return number

    def packed(values: Column) -> Column:
        digits = F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 8, "0")), "")
        return F.when(~F.exists(values, lambda v: v > 0xFFFFFFFF), F.unhex(F.substr(digits, F.lit(1), count * 8 - lack * 2)))

    # after an ASCII character no control and no rest of a character may follow
    second = lambda v: F.call("shiftright", v, 16).bitwiseAND(F.lit(255))
    follows = lambda v: (v >= 0x80000000) | second(v).between(0x20, 0x7E) | second(v).between(0xC2, 0xF4)
    worth = F.substr(c, F.lit(1), F.lit(2)).rlike(_text_of_85(alphabet))
    worth = worth & ((F.length(c) < 5) | let(value(F.substr(c, F.lit(1), F.lit(5))), follows))
    return F.when(worth, let(F.transform(F.regexp_extract_all(full, "(?s).{5}", 0), value), packed))


def _charset(alphabet: str) -> str:
    return "^[" + "".join("\\" + c if not c.isalnum() else c for c in alphabet) + "]+$"


@bound
def radix85_bytes(c: Column) -> Column:
    return F.when(c.rlike(_charset(RADIX85)), _groups_of_five(c, RADIX85))


def ascii85_bytes(c: Column) -> Column:
    """Plain, or framed by ``<~`` and ``~>``; blanks don't count. A ``z`` stands for zeros, which aren't printable."""
    inner = F.when(F.contains(c, F.lit("~>")), F.regexp_replace(c, r"(?s)^(?:<~)?(.*)~>$", "$1")).otherwise(c)
    bare = F.when(c.rlike(r"[ \t\n\r\x0b]"), F.regexp_replace(inner, r"[ \t\n\r\x0b]", "")).otherwise(inner)
    return let(bare, lambda t: F.when(t.rlike(_charset(ASCII85)), _groups_of_five(t, ASCII85)))


#: Groups of four characters of a uuencoded line whose first, second or third byte is a control below 32.
_UU_CONTROL = r"(?s)^(?:.{4})*?(?:[ -'`-g]|.[ !01@APQ`apq]|..[ $(,048<@DHLPTX\\`dhlptx|][ -?`-\x7f])"


@bound
def uu_bytes(line: Column) -> Column:
    """One uuencoded line; its first character is the number of bytes. NULL also where whole groups hold a control."""
    six = lambda ch: F.lpad(F.bin((F.ascii(ch) - 32).bitwiseAND(63)), 6, "0")

    def sized(size: Column) -> Column:
        groups = F.floor((F.length(line) - 1) / 4).cast("int")
        wanted = F.floor((size + 2) / 3).cast("int")
        raw = _from_bits(F.array_join(F.transform(F.split(F.substr(line, 2, wanted * 4), ""), six), ""))
        fits = (size > 0) & (size <= groups * 3)
        return F.when(fits & ~F.substr(line, 2, wanted * 4 - 4).rlike(_UU_CONTROL), F.substr(raw, 1, size))

    return let((F.ascii(line) - 32).bitwiseAND(63), sized)


# ---------------------------------------------------------------- folding


@cache
def digit_table() -> dict[str, str]:
    """Every non-ASCII character whose numeric value is a single digit."""
    values = ((chr(p), unicodedata.numeric(chr(p), None)) for p in range(128, 0x110000))
    return {c: str(int(v)) for c, v in values if v is not None and v in range(10)}


@cache
def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that compatibility folding replaces by one character, and by several."""
    one, more = {}, {}
    for point in range(128, 0x110000):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        plain = unicodedata.normalize("NFKC", chr(point))
        if plain != chr(point):
            (one if len(plain) == 1 else more)[chr(point)] = plain
    return one, more


def _class_of(characters: str) -> str:
    """Character class of ``characters``, by ranges of neighbours."""
    points, ranges = sorted(map(ord, characters)), []
    for point in points:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


@cache
def _plain_letters() -> str:
    """Pattern of texts of ASCII and of those Latin letters that no folding changes."""
    one, more = compatible()
    changed = {*one, *more, *digit_table(), *INVISIBLE}
    return "^[\\x00-\\x7f" + _class_of("".join(c for c in map(chr, range(0xC0, 0x250)) if c not in changed))[1:-1] + "]*+\\z"


def foldable(c: Column) -> Column:
    """Folding may change the text, or it holds signs beyond plain letters; most texts in Latin script don't."""
    return non_ascii(c) & ~c.rlike(_plain_letters())


@bound
def fold_compatible(c: Column) -> Column:
    """Compatibility folding character by character (marks are not composed across characters)."""
    one, more = compatible()
    every = "".join(more)

    def rest(out: Column) -> Column:
        # a look-up a character tells whether the long class of characters has to be searched at all
        several = F.length(F.translate(out, every, "")) != F.length(out)
        full = replaced(out, _class_of(every), lambda m: F.element_at(const(more, "map<string,string>"), m))
        return F.when(several, full).otherwise(out)

    return F.when(foldable(c), let(F.translate(c, "".join(one), "".join(one.values())), rest)).otherwise(c)


@bound
def fold_digits(c: Column) -> Column:
    """Single-digit numerals of any script to ASCII."""
    table = digit_table()
    return F.when(foldable(c), F.translate(c, "".join(table), "".join(table.values()))).otherwise(c)


@bound
def strip_invisible(c: Column) -> Column:
    return F.when(foldable(c), F.translate(c, INVISIBLE, "")).otherwise(c)


@bound
def cjk_value(run: Column) -> Column:
    """Integer that a run of CJK numerals with units spells: a fold over its characters.

    State: settled myriads, the part below the next myriad, the digit that waits for its unit.
    """
    digits, units, myriads = (const(t, "map<string,bigint>") for t in (CJK_DIGITS, CJK_UNITS, CJK_MYRIADS))
    zero = F.lit(0).cast("long")
    state = lambda settled, below, waiting: F.struct(settled.alias("settled"), below.alias("below"), waiting.alias("waiting"))

    def step(s: Column, ch: Column) -> Column:
        digit, unit, myriad = (F.try_element_at(t, ch) for t in (digits, units, myriads))
        implied = F.when(s["waiting"] == 0, F.lit(1).cast("long")).otherwise(s["waiting"])
        return (
            F.when(digit.isNotNull(), state(s["settled"], s["below"], digit))
            .when(unit.isNotNull(), state(s["settled"], s["below"] + implied * unit, zero))
            .otherwise(state(s["settled"] + (s["below"] + s["waiting"]) * myriad, zero, zero))
        )

    total = F.aggregate(F.split(run, ""), state(zero, zero, zero), step, lambda s: s["settled"] + s["below"] + s["waiting"])
    return total.cast("string")


@bound
def fold_cjk_numerals(c: Column, longest: int = 128) -> Column:
    """Runs of CJK numerals with a unit to their integers; runs beyond ``longest`` characters stay."""
    every = "".join([*CJK_DIGITS, *CJK_UNITS, *CJK_MYRIADS])
    unit = "[" + "".join([*CJK_UNITS, *CJK_MYRIADS]) + "]"
    fold = lambda m: F.when(m.rlike(unit) & (F.length(m) <= longest), cjk_value(m)).otherwise(m)
    return F.when(c.rlike(unit), replaced(c, f"[{every}]+", fold)).otherwise(c)


@bound
def spellings(c: Column, longest: int = 65_536) -> Column:
    """Equivalent spellings of a text; digits are folded up to ``longest`` characters."""
    seeds = F.when(F.contains(c, F.lit("\\")), F.array_distinct(F.array(c, unescape(c)))).otherwise(F.array(c))
    wide = F.flatten(F.transform(seeds, lambda s: F.when(foldable(s), F.array(s, fold_compatible(s))).otherwise(F.array(s))))
    bare = F.flatten(F.transform(wide, lambda w: F.when(foldable(w), F.array(w, strip_invisible(w))).otherwise(F.array(w))))

    def folded(b: Column) -> Column:
        short = (F.length(b) <= longest) & foldable(b)
        return F.when(short, F.array(b, fold_digits(b), fold_digits(fold_cjk_numerals(b)))).otherwise(F.array(b))

    every = F.filter(F.array_distinct(F.flatten(F.transform(F.array_distinct(bare), folded))), lambda t: t != "")
    plain = ~F.contains(c, F.lit("\\")) & (c != "") & ~foldable(c)
    return F.when(plain, F.array(c)).otherwise(every)


@bound
def digits_of(c: Column) -> Column:
    """All digits of a text after folding, in order."""
    plain = F.when(foldable(c), fold_digits(fold_cjk_numerals(strip_invisible(fold_compatible(c))))).otherwise(c)
    return F.regexp_replace(plain, "[^0-9]+", "")


@bound
def digit_readings(c: Column) -> Column:
    """Digits read forwards and backwards."""
    return F.filter(F.array_distinct(F.array(digits_of(c), digits_of(F.reverse(c)))), lambda d: d != "")


# ---------------------------------------------------------------- one round of decoding

#: Codecs of whole texts by name, with the least length of the packed text they apply to.
WHOLE = {
    "base64": (lambda t, packed: base64_bytes(packed), 8),
    "base32": (lambda t, packed: base32_bytes(packed), 8),
    "hex": (lambda t, packed: hex_bytes(t), 8),
    "base85": (lambda t, packed: radix85_bytes(t), 0),
    "ascii85": (lambda t, packed: ascii85_bytes(t), 0),
}
#: Characters that a codec's text may have where measuring it takes more than a look; hex may begin with its mark.
CHARACTERS = {"base32": "^[A-Za-z2-7=]+$", "hex": r"^(?:0[xX])?[0-9a-fA-F:\-]*$"}
FOUND = "array<struct<codec:string,product:string>>"


def _found(codec: str, product: Column) -> Column:
    return F.struct(F.lit(codec).alias("codec"), product.alias("product"))


def _radix(t: Column, codecs: dict[str, int]) -> Column:
    """(codec, product) of the radix codecs at their least lengths."""

    def tried(name: str, packed: Column) -> Column:
        size = F.length(F.replace(packed, F.lit("="), F.lit(""))) if name == "base32" else F.length(packed)
        if name == "hex":
            size = F.length(F.regexp_replace(F.regexp_replace(t, "^0[xX]", ""), r"[:\s\-]", ""))
        # a text with another character has no bytes: the first one ends the search
        fits = packed.rlike(CHARACTERS[name]) if name in CHARACTERS else F.lit(True)
        return _found(name, F.when(fits & (size >= codecs[name]), shown(WHOLE[name][0](t, packed))))

    return let(without_blanks(t), lambda packed: F.array(*[tried(name, packed) for name in codecs]))


def without_blanks(t: Column) -> Column:
    return F.when(t.rlike(r"\s"), F.regexp_replace(t, r"\s+", "")).otherwise(t)


@bound
def trimmed(c: Column) -> Column:
    """Without blanks of any script at both ends."""
    edge = F.concat(F.substr(c, F.lit(1), F.lit(1)), F.right(c, F.lit(1)))
    return F.when(edge.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


@bound
def products(c: Column, reverse: bool = True) -> Column:
    """Array of (codec, product): every other printable text that one codec makes of ``c``."""
    plain = F.when(
        F.contains(c, F.lit("begin")) | F.contains(c, F.lit("end")), F.regexp_replace(F.regexp_replace(c, r"\bbegin\s+[^\n]*", ""), r"\bend\b", "")
    ).otherwise(c)
    split = let(plain, lambda p: F.when(p.rlike(r"[\n|]"), F.split(p, r"[\n|]+", -1)).otherwise(F.array(p)))
    lines = F.transform(split, lambda line: _found("uu", shown(uu_bytes(F.rtrim(line, "\r\n")))))
    seeds = let(trimmed(c), lambda t: F.when(foldable(t), F.array_distinct(F.array(t, fold_compatible(t)))).otherwise(F.array(t)))
    none = F.array().cast("array<string>")
    unmarked = let(seeds, lambda ss: F.when(F.contains(c, F.lit("&")), F.array_except(F.transform(ss, lambda s: html_text(s)), ss)).otherwise(none))
    pooled = F.struct(seeds.alias("seeds"), unmarked.alias("plain"))
    least = {name: size for name, (_, size) in WHOLE.items()}

    def of(t: Column) -> Column:
        changed = let(url_text(t), lambda u: F.when((u != t) & printable(u), u))
        extra = [_found("url", F.when(F.contains(t, F.lit("%")), changed))]
        if reverse:
            extra.append(_found("reverse", F.reverse(t)))
        return F.concat(_radix(t, least), F.array(*extra))

    def all_of(p: Column) -> Column:
        pool = F.filter(F.concat(p["seeds"], p["plain"]), lambda t: t != "")
        return F.concat(lines, F.transform(p["plain"], lambda t: _found("html", t)), F.flatten(F.transform(pool, of)))

    return F.filter(let(pooled, all_of), lambda f: f["product"].isNotNull() & (f["product"] != "") & (f["product"] != c))


def product_texts(c: Column, reverse: bool = True) -> Column:
    return F.array_distinct(F.transform(products(c, reverse), lambda f: f["product"]))


def short_products(c: Column, longest: int = 1024) -> Column:
    """Readings of short fragments, which :func:`products` leaves alone."""
    found = let(F.regexp_replace(c, r"\s+", ""), lambda t: F.when(F.length(t) <= longest, _radix(t, {"base64": 4, "base32": 2, "hex": 2})))
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(found, F.array().cast(FOUND)), lambda f: f["product"])))
