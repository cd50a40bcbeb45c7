"""Value evidence and structural suspicion of calls that declare an empty scope.

A body is a VARIANT walked level by level; values are decoded, folded and matched by column
expressions (:mod:`callwarden.functions.decode`), and split numbers are put together by an automaton. Everything
stays in the call's own row: no exchange, no key and no Python. :func:`decode_frontier` is the same
decoding as a set job over a table of texts, with one row for each product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as C

from callwarden.functions import automaton, shapes
from callwarden.functions import decode as D
from callwarden.functions import patterns as P
from callwarden.functions import sqlx as F
from callwarden.functions.sqlx import E
from callwarden.operators.staging import with_texts
from callwarden.session import cut_lineage

NODES = "array<struct<key:string,value:variant,skip:boolean>>"


@dataclass(frozen=True)
class EvidenceLimits:
    """Bounds that the specification sets; beyond those on values and keys a call goes to review."""

    rounds: int = 3  # decoding rounds
    values: int = 12  # more values are a reason for review
    keys: int = 32  # more keys are a reason for review
    value_depth: int = 6  # values below are not read
    key_depth: int = 8  # keys below are not read
    fold_chars: int = 65_536  # longer values count by their digits only
    decode_chars: int = 16_384  # longer pool texts are not decoded
    pair_chars: int = 4_096  # longer pairs of pool texts are not decoded
    join_chars: int = 128  # longer joined texts are not searched
    join_values: int = 12  # values whose raw texts are joined in all orders
    shard_digits: int = 24  # longer digit strings are no shards


LIMITS = EvidenceLimits()


# ---------------------------------------------------------------- bodies


def _children(nodes: E, level: E) -> E:
    """Nodes one level below; ``skip`` marks what lies under a top-level ``consent_scope``."""
    none = F.array().cast(NODES)

    def of(n: E) -> E:
        scope = lambda e: F.when(level == 1, F.lower(e["key"]) == "consent_scope").otherwise(n["skip"])
        members = F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>"))
        named = F.transform(members, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), scope(e).alias("skip")))
        items = F.try_variant_get(n["value"], "$", "array<variant>")
        listed = F.transform(items, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"), n["skip"].alias("skip")))
        return F.coalesce(named, listed, none)

    return F.flatten(F.transform(nodes, of))


def _scalar(v: E) -> E:
    """Text of a string or number as Python writes it; NULL for anything else."""
    kind, text = F.schema_of_variant(v), v.cast("string")
    wide = F.abs(v.cast("double")).between(1e-4, 1e16)
    plain = F.regexp_replace(F.regexp_replace(v.cast("double").cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", ".0")
    science = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    science = F.regexp_replace(F.regexp_replace(science, r"E(\d)", "E+$1"), "E", "e")
    return (
        F.when(kind.isin("STRING", "BIGINT"), text)
        .when(kind.startswith("DECIMAL") & ~F.contains(text, F.lit(".")) & (F.length(text) <= 18), F.concat(text, F.lit(".0")))
        .when(kind.startswith("DECIMAL"), text)
        .when(kind.isin("DOUBLE", "FLOAT") & F.contains(text, F.lit("E")) & wide, plain)
        .when(kind.isin("DOUBLE", "FLOAT"), science)
    )


def flatten_body(df: DataFrame, body: str = "body", limits: EvidenceLimits = LIMITS) -> DataFrame:
    """Add ``leaves`` (scalars), ``names`` (keys) and ``depth`` of a JSON body; empty and 0 where it is none.

    Leaves and names come level by level, within a level in order of keys. NULL bodies stay NULL.
    """
    keep = df.columns
    none = F.array().cast("array<string>")
    root = F.struct(F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(body)).alias("value"), F.lit(False).alias("skip"))
    scalars = lambda nodes: F.array_compact(F.transform(F.filter(nodes, lambda n: ~n["skip"]), lambda n: _scalar(n["value"])))
    keys = lambda nodes: F.transform(F.filter(nodes, lambda n: n["key"].isNotNull() & (n["key"] != "consent_scope")), lambda n: n["key"])

    def state(nodes: E, leaves: E, names: E, depth: E) -> E:
        return F.struct(nodes.alias("nodes"), leaves.alias("leaves"), names.alias("names"), depth.alias("depth"))

    def deeper(s: E, level: E) -> E:
        def with_level(nodes: E) -> E:
            leaves = F.when(level <= limits.value_depth, F.concat(s["leaves"], scalars(nodes))).otherwise(s["leaves"])
            names = F.when(level <= limits.key_depth + 1, F.concat(s["names"], keys(nodes))).otherwise(s["names"])
            return state(nodes, leaves, names, F.when(F.size(nodes) > 0, level).otherwise(s["depth"]))

        return D.let(_children(s["nodes"], level), with_level)

    levels = F.sequence(1, max(limits.value_depth, limits.key_depth) + 1)
    first = D.let(F.array(root), lambda nodes: state(nodes, scalars(nodes), none, F.lit(0)))
    df = with_texts(df, _facts=F.when(F.col(body).isNotNull(), F.aggregate(levels, first, deeper)))
    return df.select(*keep, "_facts.leaves", "_facts.names", "_facts.depth")


# ---------------------------------------------------------------- decoding


def decode_frontier(df: DataFrame, column: str = "value", rounds: int = LIMITS.rounds, reverse: bool = True) -> DataFrame:
    """Rows (``column``, product, codec, depth, made_of): every text that up to ``rounds`` codecs make of a text.

    A breadth-first search over the distinct texts: a round decodes only the products that the last
    one found first, an anti join with all texts reached so far keeps the others out, and of several ways to
    a product the least (codec, made_of) is kept. A round without new products ends the search.
    """
    origin = C.col(column).alias("origin")
    level = df.where(C.col(column).isNotNull()).select(origin, C.col(column).alias("product")).distinct()
    level = cut_lineage(level.select("origin", "product", C.lit(None).cast("string").alias("codec"), C.lit(0).alias("depth"), C.lit(None).cast("string").alias("made_of")))
    reached = [level]
    for depth in range(1, rounds + 1):
        texts = level.select(C.col("product").alias("made_of")).distinct()
        # the outer form: else the optimizer puts the codecs into a filter of its own as well
        made = texts.select("made_of", C.inline_outer(D.products(F.col("made_of"), reverse).column())).where("product is not null")
        new = level.select("origin", C.col("product").alias("made_of")).join(made, "made_of")
        new = new.groupBy("origin", "product").agg(C.min(C.struct("codec", "made_of")).alias("way"))
        before = reached[0].select("origin", "product")
        for more in reached[1:]:
            before = before.union(more.select("origin", "product"))
        level = cut_lineage(new.join(before, ["origin", "product"], "left_anti").select("origin", "product", "way.codec", C.lit(depth).alias("depth"), "way.made_of"))
        if level.isEmpty():
            break
        reached.append(level)
    found = reached[1] if len(reached) > 1 else reached[0].where("false")
    for more in reached[2:]:
        found = found.union(more)
    return found.withColumnRenamed("origin", column)


# ---------------------------------------------------------------- shapes of values


def first_named(names: E) -> E:
    """Of an array of shapes the one that the table of shapes has first."""
    order = F.array(*[F.lit(name) for name, _ in P.EMBEDDED_SHAPES])
    return F.get(F.array_intersect(order, names), F.lit(0))


def _joined_raw(values: E, limits: EvidenceLimits, triples: bool = True) -> E:
    """Shape that appears when the raw texts of two or three values are put together, in any order.

    Only values with a digit, an ``@`` or a degree sign can take part in a shape; the shortest of the
    others stands for all as a neighbour without effect.
    """
    active = F.filter(values, lambda v: v.rlike("[0-9@°]") & (F.length(v) <= limits.join_chars))
    idle = F.slice(F.array_sort(F.filter(values, lambda v: ~v.rlike("[0-9@°]")), lambda a, b: F.length(a) - F.length(b)), 1, 1)

    def joined(parts: E) -> E:
        index = F.sequence(F.lit(0), F.size(parts) - 1)
        at = lambda i: F.get(parts, i)

        @D.bound
        def shape(text: E) -> E:
            worth = text.rlike(r"[@°]|[0-9]\.[0-9]{2}") | (F.length(F.regexp_replace(text, "[^0-9]+", "")) >= 11)
            return F.when((F.length(text) <= limits.join_chars) & worth, shapes.embedded_shape(text))

        def after(i: E, j: E) -> E:
            third = F.transform(index, lambda k: F.when((k != i) & (k != j), shape(F.concat(at(i), at(j), at(k)))))
            return F.concat(F.array(shape(F.concat(at(i), at(j)))), third) if triples else F.array(shape(F.concat(at(i), at(j))))

        none = F.array().cast("array<string>")
        every = F.flatten(F.transform(index, lambda i: F.flatten(F.transform(index, lambda j: F.when(i != j, after(i, j)).otherwise(none)))))
        return F.when(F.size(parts) >= 2, first_named(every))

    return F.when(F.size(active) > 0, D.let(F.slice(F.concat(active, idle), 1, limits.join_values), joined))


def _products(value: E, rounds: int) -> E:
    """Texts that up to ``rounds`` codecs make of a value, all that may have a shape: each round decodes what the last one found first."""
    state = lambda level, seen: F.struct(level.alias("level"), seen.alias("seen"))

    def one(s: E, _: E) -> E:
        # up to three ASCII characters are no shape, and no codec makes more bytes of them
        worth = F.filter(s["level"], lambda t: (F.octet_length(t) > 3) | D.non_ascii(t))
        made = F.array_distinct(F.flatten(F.transform(worth, lambda t: D.product_texts(t))))
        return D.let(F.array_except(made, s["seen"]), lambda new: state(new, F.concat(s["seen"], new)))

    seen = F.aggregate(F.sequence(1, rounds), state(F.array(value), F.array(value)), one, lambda s: s["seen"])
    return D.let(seen, lambda all_: F.slice(all_, 2, F.size(all_)))


def with_value_shapes(df: DataFrame, body: str, limits: EvidenceLimits) -> DataFrame:
    """Add ``value_shapes``: sorted shapes found on values, decoded values, joined values, or the text.

    A value is decoded only if it has no shape itself.
    """
    keep, present = df.columns, F.col(body).isNotNull()
    trimmed = F.transform(F.col("leaves"), D.trimmed)
    plain = F.transform(F.col("leaves"), lambda v: D.fold_digits(D.strip_invisible(D.unescape(v))))
    df = with_texts(
        df, present, _values=F.filter(trimmed, lambda v: v != ""), _parts=F.filter(plain, lambda v: v != ""),
        _texts=D.spellings(F.col(body), limits.fold_chars),
    )

    def own(v: E) -> E:
        return F.when(F.length(v) <= limits.fold_chars, D.let(D.spellings(v, limits.fold_chars), shapes.pii_shape)).otherwise(shapes.digit_shape(D.digits_of(v)))

    numbers = automaton.joined_shape(F.transform(F.col("_parts"), lambda p: D.digit_readings(p)))
    df = with_texts(
        df, present, _own=F.transform(F.col("_values"), own), _numbers=numbers,
        _text=shapes.first_of(F.col("_texts"), shapes.embedded_shape),
    )
    # no shape comes before a mobile number
    raw = F.when(~F.coalesce(F.col("_numbers") == "mobile", F.lit(False)), _joined_raw(F.col("_parts"), limits))
    df = with_texts(df, present, _raw=raw)
    hidden = F.zip_with(F.col("_values"), F.col("_own"), lambda v, o: F.when(o.isNull() & (F.length(v) <= limits.fold_chars), v))
    products = F.array_distinct(F.flatten(F.transform(F.array_compact(hidden), lambda v: _products(v, limits.rounds))))
    def strong(p: E) -> E:
        # in plain letters a shape has a digit or a sign of addresses, and eleven characters, a point or an exponent
        worth = D.foldable(p) | F.contains(p, F.lit("\\")) | (p.rlike("[0-9@]") & ((F.length(p) >= 11) | p.rlike("[@.eE]")))
        return F.when(worth, F.nullif(D.let(D.spellings(p, limits.fold_chars), shapes.pii_shape), "opaque"))

    split = F.when(F.size(F.col("_parts")) >= 2, first_named(F.array(F.col("_numbers"), F.col("_raw"))))
    ends = F.array(F.concat(split, "(split)"), F.concat(F.col("_text"), "(text)"))
    encoded = F.transform(F.array_distinct(F.array_compact(F.transform(products, strong))), lambda n: F.concat(n, "(encoded)"))
    df = with_texts(df, present, _hits=F.concat(F.array_compact(F.col("_own")), encoded, F.array_compact(ends)))
    # without a gap it is the text itself, which has no shape here
    bare = shapes.first_of(F.col("_texts"), lambda f: F.when(f.rlike(P.DIGIT_GAP), shapes.embedded_shape(F.regexp_replace(f, P.DIGIT_GAP, ""))))
    collapsed = F.array_compact(F.array(F.concat(bare, "(text)")))
    found = F.when(F.size(F.col("_hits")) > 0, F.array_sort(F.array_distinct(F.col("_hits")))).when(F.col("_hits").isNotNull(), collapsed)
    return with_texts(df, present, value_shapes=found).select(*keep, "value_shapes")


# ---------------------------------------------------------------- structure


def visible(c: E) -> E:
    """Printable ASCII part of a token."""
    return F.regexp_replace(c, r"[^\x21-\x7e]", "")


def dense_token(v: E) -> E:
    return F.length(visible(v)) >= 12


def compact_token(v: E) -> E:
    """Short tokens that could be a number written in some base."""
    t = visible(v)
    n, digits = F.length(t), t.rlike("^[0-9]+$")
    mixed = (
        (t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
        | (t.rlike("[A-Z]") & t.rlike("[a-z]"))
        | t.rlike("[^0-9A-Za-z]")
    )
    return (v != "") & (
        (v != t)
        | ((n == 11) & digits)
        | (n.between(6, 11) & ~digits)
        | (n.between(2, 12) & mixed)
    )


def compact_key(k: E) -> E:
    t = visible(k)
    return (k != "") & ((k != t) | (F.length(t) == 1))


def digit_shard(v: E) -> E:
    """A piece that may be part of a longer number."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return F.when(v.rlike("^[0-9]+$"), F.length(v) <= 6).otherwise(digits.between(2, 8))


def _long_product(v: E) -> E:
    """Some codec makes at least eight printable characters of a text."""
    return F.exists(D.products(v, reverse=False), lambda f: F.length(F.trim(f["product"])) >= 8)


#: Bytes, in hex, with which printable UTF-8 text may begin; the last character may be cut. Whole characters
#: are taken possessively, as a way back would keep stack for each of them and can't lead to another reading.
_TEXT_BEGIN = (
    "^(?:[2-6].|7[0-9A-E]|(?:C[2-9A-F]|D.)[89AB].|E.(?:[89AB].){2}|F[0-4](?:[89AB].){3})*+"
    "(?:(?:C[2-9A-F]|D.|E.|F[0-4])|(?:E.|F[0-4])[89AB].|F[0-4](?:[89AB].){2})?$"
)


def _may_begin(v: E) -> E:
    """The whole groups of a text may be the begin of printable text under some codec.

    What a longer text decodes to begins with these bytes, so texts that fail can't open a pair.
    """
    t = D.without_blanks(v)

    def begins(raw: E) -> E:
        return F.hex(raw).rlike(_TEXT_BEGIN)

    def whole(size: int) -> E:
        return F.substr(t, F.lit(1), F.floor(F.length(t) / size).cast("int") * size)

    def possible(pattern: str, size: int, decode) -> E:
        fits = t.rlike(pattern)
        return fits & ((F.length(t) < size) | F.coalesce(begins(decode(F.when(fits, whole(size)))), F.lit(False)))

    radix = (
        possible("^[A-Za-z0-9+/_-]+$", 4, D.base64_bytes)
        | possible("^[A-Za-z2-7]+$", 8, D.base32_bytes)
        | possible("^(?:0[xX])?[0-9a-fA-F:-]+$", 2, lambda w: D.hex_bytes(t))
        | possible(D._charset(D.RADIX85), 5, D.radix85_bytes)
        | possible(D._charset(D.ASCII85), 5, D.ascii85_bytes)
    )
    # hex texts with marks between the pairs and framed texts are rare enough to try always
    framed = v.rlike(r"^(?:0[xX])?[0-9a-fA-F:\s-]+$") | v.startswith("<~")
    lined = (F.ascii(v) - 32).bitwiseAND(F.lit(63)) >= 8
    return F.coalesce(radix, F.lit(False)) | framed | lined | v.rlike("[%&]") | D.non_ascii(v)


def with_suspicion(df: DataFrame, limits: EvidenceLimits) -> DataFrame:
    """Add ``suspicion``: first structural reason to distrust an empty declaration, NULL when there is none."""
    keep, present = df.columns, F.col("leaves").isNotNull()
    short = lambda v: F.length(v) <= limits.decode_chars
    none = F.array().cast("array<string>")
    pool, made, parts = F.col("pool"), F.col("_made"), F.col("_shards")
    df = with_texts(df, present, pool=F.array_distinct(F.concat(F.col("leaves"), F.col("names"))))
    # beyond these bounds the reason is known already
    few = (F.size(F.col("leaves")) <= limits.values) & (F.size(F.col("names")) <= limits.keys)
    df = with_texts(df, present, pool=F.when(few, pool))
    df = with_texts(
        df, present, _made=F.transform(pool, lambda v: F.when(short(v), D.product_texts(v, reverse=False)).otherwise(none)),
        _openers=F.filter(F.sequence(0, F.size(pool) - 1), lambda i: _may_begin(F.get(pool, i))),
        _readings=F.transform(pool, lambda v: D.digit_readings(v)),
        _short=F.transform(pool, lambda v: F.when(short(v), D.short_products(v)).otherwise(none)),
        _raw=_joined_raw(pool, limits, triples=False),
    )
    decodable = F.exists(F.flatten(made), lambda t: F.length(F.trim(t)) >= 8)

    def pair(i: E, b: E, j: E) -> E:
        size = F.length(F.get(pool, i)) + F.length(b)
        return F.when((i != j) & (size >= 8) & (size <= limits.pair_chars), F.concat(F.get(pool, i), b))

    joins = F.flatten(F.transform(F.col("_openers"), lambda i: F.array_compact(F.transform(pool, lambda b, j: pair(i, b, j)))))
    own = F.transform(F.col("_readings"), lambda r: F.array(F.coalesce(F.get(r, 0), "")))
    decoded = F.zip_with(F.col("_short"), made, lambda s, m: F.array_distinct(F.flatten(F.transform(F.array_union(s, m), lambda t: D.digit_readings(t)))))
    df = with_texts(df, present, _decodable=decodable)
    df = with_texts(
        df, present, _joinable=~F.col("_decodable") & F.exists(joins, _long_product), _pair=automaton.joined_shape(own, triples=False).isNotNull() | F.col("_raw").isNotNull(),
        _shards=decoded,
    )
    shards = F.size(F.filter(parts, lambda s: F.exists(s, lambda d: F.length(d).between(1, 6))))
    readings = F.filter(F.array_distinct(F.concat(F.flatten(F.col("_readings")), F.flatten(parts))), lambda d: F.length(d) <= limits.shard_digits)
    known = F.col("_decodable") | F.col("_joinable") | F.col("_pair")
    df = with_texts(df, present, _again=F.when(~known, automaton.joined_shape(F.transform(readings, lambda d: F.array(d)))))
    folded = F.filter(pool, lambda v: (F.length(v) <= limits.fold_chars) & F.coalesce(digit_shard(D.fold_digits(v)), F.lit(False)))
    reason = (
        F.when(F.size(F.col("leaves")) > limits.values, "excessive_value_count")
        .when(F.size(F.col("names")) > limits.keys, "excessive_key_count")
        .when(F.col("_decodable"), "decodable_value")
        .when(F.col("_joinable"), "cross_value_encoded_shard")
        .when((F.size(pool) >= 2) & F.col("_pair"), "split_key_shape")
        .when((F.size(pool) >= 2) & (shards >= 3), "decoded_short_shards")
        .when((F.size(pool) >= 2) & F.col("_again").isNotNull(), "decoded_split_key_shape")
        .when(F.col("depth") > limits.value_depth, "excessive_nesting")
        .when(F.size(folded) >= 3, "short_digit_shards")
        .when(F.exists(pool, lambda v: dense_token(v)), "dense_token")
        .when(F.exists(pool, lambda v: compact_token(v)) | F.exists(F.col("names"), lambda k: compact_key(k)), "integer_base_token")
    )
    return with_texts(df, present, suspicion=reason).select(*keep, "suspicion")


def with_evidence(df: DataFrame, body: str = "body", needed: Column | None = None, limits: EvidenceLimits = LIMITS) -> DataFrame:
    """Add ``value_shapes`` (array, NULL where not ``needed``) and ``suspicion``."""
    keep = df.columns
    df = df.withColumn("_source", C.col(body) if needed is None else C.when(needed, C.col(body)))
    df = flatten_body(df, "_source", limits)
    df = with_suspicion(with_value_shapes(df, "_source", limits), limits)
    return df.select(*keep, "value_shapes", "suspicion")
