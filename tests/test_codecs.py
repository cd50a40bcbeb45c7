"""Codecs, folding and fragments against the standard library and all orders."""

import base64
import binascii
import html
import itertools
import random
import re
import unicodedata
import urllib.parse

from callwarden.functions import automaton, sqlx
from callwarden.functions import decode as D
from callwarden.operators import evidence, restore

PLAIN = ["13800138000", "hello world", "abc", "中文测试", "a@b.cn", "x" * 20, "３８", "①②③", "½ cup", "ﬁne ㎏", "&amp;#49;&#x33;&lt", "&notit; &#6;&#0;&#x80;", "no", "a|b\nc"]
CODERS = {
    "base64": lambda raw: base64.b64encode(raw).decode(), "base32": lambda raw: base64.b32encode(raw).decode(), "hex": lambda raw: raw.hex(),
    "base85": lambda raw: base64.b85encode(raw).decode(), "ascii85": lambda raw: base64.a85encode(raw).decode(), "uu": lambda raw: binascii.b2a_uu(raw[:45]).decode().rstrip("\n"),
}


def read(spark, values, **expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *[e.column().alias(n) for n, e in expressions.items()]).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.i)]


def test_every_codec_gives_back_what_was_encoded(spark):
    cases = [(name, text, code(text.encode())) for name, code in CODERS.items() for text in PLAIN if len(text) >= 6]
    rows = read(spark, [c for _, _, c in cases], found=D.products(sqlx.col("v")))
    for (name, text, coded), row in zip(cases, rows):
        found = {(f.codec, f.product) for f in row["found"]}
        whole = text.encode() if name != "uu" else text.encode()[:45]
        printable = whole.decode("utf-8", "replace").isprintable()
        assert ((name, text) in found) == printable, (name, text, coded, found)
        assert coded[::-1] == coded or any(codec == "reverse" for codec, _ in found)


def test_text_functions_equal_the_standard_library(spark):
    values = [*PLAIN, "%31%33%zz+%e4%b8%ad", "&notanentity; &copy2 &#xD800; &#1114112;", "\\u0031\\x33", "", "é٣④"]
    v = sqlx.col("v")
    rows = read(spark, values, html=D.html_text(v), url=D.url_text(v), wide=D.fold_compatible(v), digits=D.fold_digits(v))
    for text, row in zip(values, rows):
        assert row["html"] == html.unescape(text), text
        assert row["url"] == urllib.parse.unquote(text), text
        assert row["wide"] == unicodedata.normalize("NFKC", text), text
        folded = "".join(str(int(n)) if (n := unicodedata.numeric(c, -1)) in range(10) and not c.isascii() else c for c in text)
        assert row["digits"] == folded, text


def test_cjk_numerals(spark):
    cases = {
        "壹佰叁拾捌亿壹拾叁万捌仟": "13800138000", "十": "10", "二十三": "23", "百万": "1000000", "一三八": "一三八", "共三千零五元": "共3005元",
        "万" * 200: "万" * 200, "两": "两", "": "",
    }
    rows = read(spark, list(cases), folded=D.fold_cjk_numerals(sqlx.col("v")))
    assert [r["folded"] for r in rows] == list(cases.values())


def by_all_orders(fragments, most):
    rank = ("mobile", "idcard", "bankcard")
    for size in range(2, most + 1):
        names = set()
        for order in itertools.permutations(fragments, size):
            for digits in map("".join, itertools.product(*order)):
                if re.fullmatch(r"(?:0086|00|86|0)?0*1[3-9]\d{9}", digits):
                    names.add("mobile")
                elif len(digits) in range(16, 20):
                    names.add("idcard" if len(digits) == 18 else "bankcard")
        if names:
            return min(names, key=rank.index)
    return None


def test_fragments_equal_all_orders(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        number = draw.choice(["13812345678", "008613912345678", "0013800138000"])
        a, b = sorted(draw.sample(range(1, 11), 2))
        parts = [[p] for p in (number[:a], number[a:b], number[b:]) if draw.random() < 0.8]
        for _ in range(draw.randrange(5)):
            parts.append(["".join(draw.choice("0123456789") for _ in range(draw.choice([0, 1, 2, 3, 6, 7, 8, 9, 30]))) for _ in range(draw.choice([1, 2]))])
        draw.shuffle(parts)
        rows.append((i, parts))
    df = spark.createDataFrame(rows, "i int, f array<array<string>>")
    f = sqlx.col("f")
    got = {r.i: (r.two, r.three) for r in df.select("i", automaton.joined_shape(f, triples=False).column().alias("two"), automaton.joined_shape(f).column().alias("three")).collect()}
    for i, parts in rows:
        assert got[i] == (by_all_orders(parts, 2), by_all_orders(parts, 3)), parts


def test_fragments_of_any_number(spark):
    many = [[str(100 + i)] for i in range(200)] + [["138"], ["0013"], ["8000"]]
    df = spark.createDataFrame([(many,)], "f array<array<string>>")
    assert df.select(automaton.joined_shape(sqlx.col("f")).column()).first()[0] == "mobile"


def test_frontier_stops_keeps_depths_and_visits_once(spark):
    once = base64.b64encode(b"plain text").decode()
    values = [base64.b64encode(once.encode()).decode(), once, "zz", None, once]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    rows = {(r.value, r.product): (r.codec, r.depth, r.made_of) for r in evidence.decode_frontier(df, rounds=3, reverse=False).collect()}
    assert rows[values[0], once] == ("base64", 1, values[0])
    assert rows[values[0], "plain text"] == ("base64", 2, once)
    assert rows[once, "plain text"] == ("base64", 1, once)
    short = evidence.decode_frontier(df, rounds=1, reverse=False)
    assert {r.depth for r in short.collect()} == {1}
    assert evidence.decode_frontier(df.where("value = 'zz'"), reverse=False).count() == 0


def test_flatten_reads_levels_numbers_and_prefixes(spark):
    bodies = ['{"a": {"b": [1, 2.5, "x", true, null]}, "consent_scope": ["P"], "m": {"consent_scope": "q"}} tail', "[]", "nope", "", None, '{"n": 13800138000.0, "e": 1e20, "f": 1e5}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    rows = {r.i: r for r in evidence.flatten_body(df).collect()}
    assert (sorted(rows[0].leaves), sorted(rows[0].names), rows[0].depth) == (["1", "2.5", "q", "x"], ["a", "b", "m"], 3)
    assert [(rows[i].leaves, rows[i].depth) for i in (1, 2, 3)] == [([], 0)] * 3 and rows[4].leaves is None
    assert sorted(rows[5].leaves) == ["100000.0", "13800138000.0", "1e+20"]


def test_rounds_carry_only_changing_tokens(spark):
    deep = "granted"
    for _ in range(3):
        deep = "b64:" + base64.b64encode(deep.encode()).decode()
    key, plain = b"k3y", b"the hidden name"
    fog = "sf:" + base64.b64encode(key).decode() + ":" + base64.b64encode(bytes(c ^ key[i % 3] for i, c in enumerate(plain))).decode()
    df = spark.createDataFrame([(deep,), ("plain.Name",), (fog,), ("é&amp;",), (None,), (deep,)], "token string")
    rows = restore.decode_tokens(df).collect()
    got = {r.token: (r.decoded, r.applied) for r in rows}
    assert len(rows) == 6 and got[deep] == ("granted", ["base64"] * 3) and got[None] == (None, None)
    assert got["plain.Name"] == ("plain.Name", []) and got[fog] == (plain.decode(), ["stringfog"])
    assert got["é&amp;"] == ("é&", ["nfkc", "html_entity"])


def test_patterns_over_long_texts_take_no_stack_for_each_character(spark):
    lines = "plain words, ümläut\x00" * 20_000
    values = ["%41" + "plain words " * 40_000, base64.b64encode(("é" * 200_000).encode()).decode(), "[" + '"' + "a" * 500_000 + '"]', lines]
    strings = sqlx.col("v").rlike(restore.JSON_STRING)
    rows = read(spark, values, fine=D.printable(sqlx.col("v")), found=D.products(sqlx.col("v")), begins=evidence._may_begin(sqlx.col("v")), strings=strings)
    assert [r["fine"] for r in rows] == [True, True, True, False]
    assert ("url", ("A" + "plain words " * 40_000).strip()) in {(f.codec, f.product) for f in rows[0]["found"]}
    assert ("base64", "é" * 200_000) in {(f.codec, f.product) for f in rows[1]["found"]}
    assert rows[1]["begins"] and rows[2]["strings"]


def test_text_begin_still_means_the_same(spark):
    texts = ["", "abc", "aé中😀", "\x01", "a\n"]
    raws = [t.encode()[:n] for t in texts for n in range(len(t.encode()) + 1)] + [b"\xff", b"a\xa9", b"\xc3\xc3"]
    old = evidence._TEXT_BEGIN.replace("*+", "*")
    rows = read(spark, [raw.hex().upper() for raw in raws], fits=sqlx.col("v").rlike(evidence._TEXT_BEGIN))
    assert [r["fits"] for r in rows] == [re.search(old, raw.hex().upper()) is not None for raw in raws]
