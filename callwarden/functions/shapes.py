"""Personal-data shapes of values, as column expressions over equivalent forms."""

from __future__ import annotations

from callwarden.functions import patterns as P
from callwarden.functions import sqlx as F
from callwarden.functions.decode import bound, foldable
from callwarden.functions.sqlx import E as Column

#: What a shape needs in a text that folding leaves alone, where digits are ASCII and there is no degree sign.
_NEEDS = {
    "mobile": "[0-9]{11}", "idcard": "[0-9]{17}", "bankcard": "[0-9]{16}", "email": "@", "coord": r"[0-9]\.[0-9]{2}", "coord1": "°",
}


def first_rule(value: Column, rules) -> Column:
    """Name of the first matching (name, pattern) rule."""
    name = F.when(F.lit(False), F.lit(""))
    for label, pattern in rules:
        hit = value.rlike("(?U)" + pattern)
        if label == "opaque":
            hit = hit & ~value.rlike(P.OPAQUE_EXEMPT)
        name = name.when(hit, F.lit(label))
    return name


@bound
def whole_shape(value: Column) -> Column:
    head = F.substr(value, F.lit(1), F.lit(32))
    worth = head.rlike(r"(?U)^[-\d]|^[A-Za-z0-9+/=_-]{32}$") | F.contains(value, F.lit("@"))
    return F.when(worth, first_rule(value, P.WHOLE_SHAPES))


def digit_shape(digits: Column) -> Column:
    return first_rule(digits, P.DIGIT_SHAPES)


def embedded_email(value: Column) -> Column:
    """An address inside the text; hopelessly many ``@`` count as one."""
    return value.rlike("(?U)" + dict(P.EMBEDDED_SHAPES)["email"]) | (
        F.length(value) - F.length(F.replace(value, F.lit("@"))) > P.MAX_AT_SIGNS
    )


@bound
def embedded_shape(value: Column) -> Column:
    """Shape found anywhere inside the text.

    The patterns look round every character; texts that lack what one needs at least are spared it.
    """

    def among(spared: bool) -> Column:
        name = F.when(F.lit(False), F.lit(""))
        for label, pattern in P.EMBEDDED_SHAPES:
            hit = embedded_email(value) if label == "email" else value.rlike("(?U)" + pattern)
            name = name.when(value.rlike(_NEEDS[label]) & hit if spared else hit, F.lit(label))
        return name

    return F.when(foldable(value), among(False)).when(value.rlike("[0-9]{11}|@|[0-9]\\.[0-9]{2}"), among(True))


def first_of(forms: Column, fn) -> Column:
    """First non-NULL ``fn(form)``."""
    return F.get(F.filter(F.transform(forms, fn), lambda n: n.isNotNull()), F.lit(0))


def digit_candidates(value: Column) -> Column:
    """Digit strings a value may stand for: expanded exponent, dropped ``.0``, bare digits."""
    plain = r"^\s*[+-]?\d+(?:\.\d+)?[eE]\s*[+-]?\d+\s*$"
    number_like = F.substr(value, F.lit(1), F.lit(1)).rlike(r"[\s+\-0-9]")
    number = F.regexp_replace(value, r"\s+", "").try_cast("double")
    expanded = F.when(
        number_like & value.rlike(plain) & (number == F.floor(number)) & (F.abs(number) < 1e18),
        number.cast("bigint").cast("string"),
    )
    tail = F.when(number_like, F.regexp_extract(value, r"^\s*([+-]?\d+)\.0+\s*$", 1))
    digits = F.when(value.rlike(r"^[0-9]+\z"), value).when(value.rlike("[0-9]") | foldable(value), F.regexp_replace(value, r"(?U)\D+", ""))
    return F.filter(
        F.array_distinct(F.array(expanded, tail, digits)), lambda d: d.isNotNull() & (d != "")
    )


def pii_shape(forms: Column) -> Column:
    """First shape of a value given its equivalent forms: whole, digits, embedded."""
    digits = F.flatten(F.transform(forms, digit_candidates))
    return F.coalesce(
        first_of(forms, whole_shape),
        F.array_min(F.transform(digits, _ranked_digit_shape))["name"],
        first_of(forms, embedded_shape),
    )


def _ranked_digit_shape(digits: Column) -> Column:
    """Struct (rank, name) so that the minimum over an unordered set is well defined."""
    rank = F.when(F.lit(False), F.lit(0))
    names = F.when(F.lit(False), F.lit(""))
    for i, (label, pattern) in enumerate(P.DIGIT_SHAPES):
        hit = digits.rlike(pattern)
        rank, names = rank.when(hit, F.lit(i)), names.when(hit, F.lit(label))
    return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), names.alias("name")))


def joined_digit_shape(digits: Column) -> Column:
    """Shape inside a pure digit string; the edges are the ends of the string."""
    n = F.length(digits)
    return (
        F.when((n >= 11) & digits.rlike(rf"^{P.MOBILE}$"), "mobile")
        .when(n == 18, "idcard")
        .when(n.between(16, 19), "bankcard")
    )
