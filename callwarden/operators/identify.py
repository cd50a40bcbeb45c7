"""Which kind of personal data a call touches.

All matching happens inside the row: the catalogue is a bounded configuration, so each call
meets only its platform's tokens as a constant array, and no exchange is needed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import vocab
from callwarden.functions.consts import const, first_by_order, known, strings
from callwarden.operators.staging import seal

TOKENS_DDL = "map<string,array<struct<token:string,spaced:string,types:array<string>>>>"
MATCHED_DDL = "array<struct<variant:string,types:array<string>>>"
SCOPE_LIST = r'(?iU)"consent_scope"\s*:\s*\[([^\]]*)\]'


def class_part(token: str) -> str | None:
    """Readable class name of a catalogue token, if it identifies a type by itself."""
    owner = token.split(" ")[0] if " " in token else token.rpartition(".")[0] or token
    name = owner.split(".")[-1].lower()
    return name if len(name) >= 5 and name not in vocab.GENERIC_CLASSES else None


def method_part(token: str) -> str | None:
    """Readable method name of a catalogue token, if it is specific enough."""
    name = token.split(" ", 1)[1] if " " in token else token.rpartition(".")[2]
    capitals = sum(c.isupper() for c in name)
    specific = len(name) >= 8 and (len(name) >= 10 or capitals >= 2)
    return name.lower() if specific else None


def class_token(token: Column) -> Column:
    """Column form of :func:`class_part`."""
    owner = F.when(token.contains(" "), F.substring_index(token, " ", 1)).when(
        token.contains("."), F.regexp_replace(token, r"\.[^.]*$", "")
    ).otherwise(token)
    name = F.lower(F.substring_index(owner, ".", -1))
    return F.when((F.length(name) >= 5) & ~name.isin(vocab.GENERIC_CLASSES), name)


def method_token(token: Column) -> Column:
    """Column form of :func:`method_part`."""
    name = F.when(token.contains(" "), F.regexp_replace(token, "^[^ ]* ", "")).otherwise(
        F.substring_index(token, ".", -1)
    )
    capitals = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    specific = (F.length(name) >= 8) & ((F.length(name) >= 10) | (capitals >= 2))
    return F.when(specific, F.lower(name))


def _by_platform(rows, part) -> dict[str, list[dict]]:
    """{platform or '*': [{token, spaced, types}]} for one part of every token."""
    index: dict[str, dict[str, list[str]]] = {p: {} for p in vocab.PLATFORMS}
    for platform, data_type, token in rows:
        name = part(token)
        if name and name != vocab.RESOLVER_TOKEN:
            types = index.setdefault(platform, {}).setdefault(name, [])
            if data_type not in types:
                types.append(data_type)
    entries = {
        p: [{"token": t, "spaced": t.replace(".", " "), "types": d} for t, d in tokens.items()]
        for p, tokens in index.items()
    }
    entries["*"] = [e for p in index for e in entries[p]]
    return entries


def _flat_types(hits: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: h["types"])))


#: Tests of one sealed column: the methods compiled from a column stay below 8,000 bytes, beyond which the JVM
#: interprets them.
TESTS = 32


def _places(df: DataFrame, entries: dict[str, list[dict]], scope: Column, fits) -> DataFrame:
    """Add ``_likely``: places in the list of all entries of those of the call's platform that fit, in order.

    Functions with a lambda are walked as a tree for each row, so every entry has a compiled test of its own.
    """
    none, place, parts = F.array().cast("array<int>"), 0, []
    for platform, es in entries.items():
        if platform != "*":
            for at in range(0, len(es), TESTS):
                tests = [F.when(fits(e), F.lit(place + at + i)) for i, e in enumerate(es[at : at + TESTS])]
                parts.append(f"_part{len(parts)}")
                df = df.withColumn(parts[-1], F.when(scope.isin(platform, "*"), F.array(*tests)).otherwise(none))
                df = seal(df, parts[-1])
            place += len(es)
    found = F.array_except(F.concat(none, *parts), F.array(F.lit(None).cast("int")))
    return df.withColumn("_likely", found).drop(*parts)


def _edge_hits(rows, part, stack: Column, words: Column, scope: Column) -> Column:
    """Types of tokens standing between non-alphanumeric edges.

    Purely alphanumeric tokens are looked up among the words of the stack; the few others
    are searched with their own constant pattern.
    """
    entries = _by_platform(rows, part)
    plain = {
        p: [e for e in es if re.fullmatch("[a-z0-9]+", e["token"])] for p, es in entries.items()
    }
    names = const({p: [e["token"] for e in es] for p, es in plain.items()}, "map<string,array<string>>")
    hits = F.filter(
        F.element_at(const(plain, TOKENS_DDL), scope), lambda e: F.array_contains(words, e["token"])
    )
    named = F.arrays_overlap(words, F.element_at(names, scope))
    types = F.when(named, _flat_types(hits)).otherwise(F.array().cast("array<string>"))
    for platform, es in entries.items():
        for e in es:
            if platform != "*" and e not in plain[platform]:
                edge = rf"(?<![a-z0-9])\Q{e['token']}\E(?![a-z0-9])"
                found = scope.isin(platform, "*") & stack.rlike(edge)
                types = F.when(found, F.array_union(types, strings(e["types"]))).otherwise(types)
    return types


def match_catalog(df: DataFrame, rows) -> DataFrame:
    """Add ``matched`` (every hit), ``kept`` and ``suppressed`` hits of full API tokens.

    A hit that is a proper substring of another hit of the same call carries no information
    of its own and is suppressed.
    """
    entries = _by_platform(rows, str.lower)
    listed = const(entries["*"], TOKENS_DDL[len("map<string,") : -1])
    df = df.withColumns(
        {
            "stack_low": F.lower("stack"),
            "scope_key": F.coalesce("platform", F.lit("*")),
        }
    )
    stack = F.col("stack_low")
    df = df.withColumn("_flat", F.replace(stack, F.lit("."), F.lit(" ")))
    df = _places(df, entries, F.col("scope_key"), lambda e: F.col("_flat").contains(F.lit(e["spaced"])))

    def fits(place: Column) -> Column:
        e = F.get(listed, place)
        return F.when(stack.contains(e["token"]) | stack.contains(e["spaced"]), place)

    gone = F.array(F.lit(None).cast("int"))
    exact = F.when(F.size("_likely") > 0, F.array_except(F.transform("_likely", fits), gone))
    df = df.withColumn("_places", F.coalesce(exact, F.col("_likely"))).drop("_flat", "_likely")

    def hit(place: Column) -> Column:
        e = F.get(listed, place)
        variant = F.when(stack.contains(e["token"]), e["token"]).otherwise(e["spaced"])
        return F.struct(variant.alias("variant"), e["types"].alias("types"))

    hits = F.transform("_places", hit)
    df = df.withColumn("matched", F.when(F.size("_places") > 0, hits).otherwise(F.array().cast(MATCHED_DDL)))
    df = df.drop("_places")
    shadowed = lambda m: F.exists(
        "matched", lambda w: (w["variant"] != m["variant"]) & w["variant"].contains(m["variant"])
    )
    several, none = F.size("matched") > 1, F.array().cast(MATCHED_DDL)
    return df.withColumns(
        {
            "kept": F.when(several, F.filter("matched", lambda m: ~shadowed(m))).otherwise(F.col("matched")),
            "suppressed": F.when(several, F.filter("matched", shadowed)).otherwise(none),
        }
    )


def resolver_type(rows) -> Column:
    """Type of a content-resolver query, decided by the URI next to it."""
    places = [p for p, _, t in rows if t.lower() == vocab.RESOLVER_TOKEN]
    stack = F.col("stack_low")
    used = F.col("scope_key").isin(*(places or [""]), "*") & (
        stack.contains(vocab.RESOLVER_TOKEN)
        | stack.contains(vocab.RESOLVER_TOKEN.replace(".", " "))
    )
    if not places:
        return F.lit(None).cast("string")
    kind = F.when(F.lit(False), F.lit(""))
    for uri, data_type in vocab.RESOLVER_URIS:
        kind = kind.when(used & stack.contains(uri), F.lit(data_type))
    return kind


def payload_evidence(df: DataFrame) -> DataFrame:
    """Add ``payload_types`` (types named by quoted keys) and ``payload_first`` (best key's type)."""
    ranked = vocab.PAYLOAD_KEYS
    df = df.withColumn(
        "quoted_keys",
        F.array_distinct(
            F.regexp_extract_all(F.lower("text"), F.lit(r'(?U)"([a-z]+)"\s*:'), F.lit(1))
        ),
    )
    types = const(dict(ranked), "map<string,string>")
    df = df.withColumn("_named", F.array_intersect(strings(k for k, _ in ranked), F.col("quoted_keys")))
    hits = F.transform("_named", lambda k: F.element_at(types, k))
    hits = F.when(F.size("_named") > 0, hits).otherwise(F.col("_named"))
    df = df.withColumn("payload_hits", hits).drop("_named")
    return df.withColumns(
        {
            "payload_types": F.array_distinct("payload_hits"),
            "payload_first": F.get("payload_hits", F.lit(0)),
        }
    )


def risk_min(types: Column) -> Column:
    """Riskiest type of a set."""
    return first_by_order(vocab.RISK_ORDER, types)


def disambiguate(types: Column, backed: Column) -> Column:
    """Struct (data_type, ambiguous): one candidate, else payload evidence, never a guess.

    ``backed`` are the candidates that payload keys support.
    """
    pair = lambda t, a: F.struct(t.alias("data_type"), F.lit(a).alias("ambiguous"))
    return (
        F.when(F.size(types) == 1, pair(F.get(types, F.lit(0)), False))
        .when(F.size(backed) == 1, pair(F.get(backed, F.lit(0)), False))
        .when(F.size(backed) > 1, pair(risk_min(backed), True))
        .otherwise(pair(F.lit(None).cast("string"), True))
    )


def identify(df: DataFrame, rows) -> DataFrame:
    """Add ``data_type`` and ``tier``; needs ``text``, ``stack`` and ``platform``.

    The first tier with any hit decides, even when it cannot settle on one type.
    """
    df = payload_evidence(match_catalog(df, rows))
    no_type = F.array().cast("array<string>")
    kept_types = F.when(F.size("kept") > 0, _flat_types(F.col("kept"))).otherwise(no_type)
    df = df.withColumn(
        "full_types",
        F.array_distinct(F.concat(kept_types, known(resolver_type(rows)))),
    )
    no_full = F.size("full_types") == 0
    df = df.withColumn("words", F.when(no_full, F.split("stack_low", "[^a-z0-9]+")))
    stack, words, scope = F.col("stack_low"), F.col("words"), F.col("scope_key")
    df = df.withColumn(
        "class_types",
        F.when(no_full, _edge_hits(rows, class_part, stack, words, scope)),
    )
    no_class = no_full & (F.size("class_types") == 0)
    df = df.withColumn(
        "method_types",
        F.when(no_class, _edge_hits(rows, method_part, stack, words, scope)),
    )
    level = (
        F.when(~no_full, "full")
        .when(F.size("class_types") > 0, "class")
        .when(F.size("method_types") > 0, "method")
    )
    names = F.regexp_extract_all(
        F.regexp_extract("text", SCOPE_LIST, 1), F.lit('"([A-Za-z_]+)"'), F.lit(1)
    )
    df = df.withColumns({"level": level})
    chosen = (
        F.when(F.col("level") == "full", F.col("full_types"))
        .when(F.col("level") == "class", F.col("class_types"))
        .when(F.col("level") == "method", F.col("method_types"))
    )
    df = df.withColumn("candidates", chosen)
    df = df.withColumns(
        {
            "backed": F.array_intersect("candidates", "payload_types"),
            "scope_type": F.when(
                F.col("level").isNull() & F.col("payload_first").isNull(), risk_min(names)
            ),
        }
    )
    df = df.withColumn(
        "settled",
        F.when(
            F.col("level").isNotNull(), disambiguate(F.col("candidates"), F.col("backed"))
        ),
    )
    unclear = F.col("settled.data_type").isNull() | (
        (F.col("level") == "full") & F.col("settled.ambiguous")
    )
    df = df.withColumns(
        {
            "data_type": F.when(F.col("level").isNotNull(), F.col("settled.data_type")).otherwise(
                F.coalesce("payload_first", "scope_type")
            ),
            "tier": F.when(
                F.col("level").isNotNull(),
                F.when(unclear, F.concat("level", F.lit("_ambiguous"))).otherwise(F.col("level")),
            )
            .when(F.col("payload_first").isNotNull(), "payload")
            .when(F.col("scope_type").isNotNull(), "consent")
            .otherwise("none"),
        }
    ).drop("words", "level", "settled", "backed", "scope_type", "payload_hits")
    return seal(df, "data_type", "tier")
