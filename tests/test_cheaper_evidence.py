"""Short cuts of the value evidence give what the long way gives."""

import random

from pyspark.sql import functions as C

from callwarden.functions import automaton
from callwarden.functions import decode as D
from callwarden.functions import sqlx as F

NUMBERS = ["13812345678", "008613812345678", "0013812345678", "110101199003071234", "6222020200112233", "28612345678", "1381234567"]


def test_few_digit_strings_make_what_the_automaton_makes(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        number = rng.choice(NUMBERS)
        cuts = sorted(rng.sample(range(1, len(number)), rng.choice([1, 2])))
        parts = [number[a:b] for a, b in zip([0, *cuts], [*cuts, len(number)])]
        rng.shuffle(parts)
        rows.append(([[p, p[::-1]][: rng.choice([1, 2])] for p in parts] + [[], ["0"]][: rng.randrange(3)],))
    df = spark.createDataFrame(rows, "f array<array<string>>")
    shapes = {}
    for few in (automaton.FEW, 0):
        monkeypatch.setattr(automaton, "FEW", few)
        three, two = (automaton.joined_shape(F.col("f"), triples=t).column() for t in (True, False))
        shapes[few] = [tuple(r) for r in df.select(three, two).collect()]
    assert shapes[8] == shapes[0]
    assert {s for s, _ in shapes[0]} == {None, "mobile", "idcard", "bankcard"}


def test_foldable_texts_are_all_that_folding_changes(spark):
    """Plain letters are left alone by every folding, and no folding is kept from other signs."""
    rows = [(chr(p),) for p in range(0x21, 0x3100) if not 0xD800 <= p < 0xE000] + [("straße é",), ("é①",), ("",)]
    df = spark.createDataFrame(rows, "c string")
    c, (one, more) = F.col("c"), D.compatible()
    signs = {*one, *more, *D.digit_table(), *D.INVISIBLE}
    for text, foldable, folded in df.select("c", D.foldable(c).column(), D.fold_digits(D.strip_invisible(D.fold_compatible(c))).column()).collect():
        assert foldable or not signs & set(text), text
        assert foldable or folded == text, text
    assert df.where(~D.foldable(c).column() & ~C.col("c").rlike("^[\\x00-\\x7f]*$")).count() > 100


def test_numeric_entities_beyond_all_numbers(spark):
    df = spark.createDataFrame([("a&#657347468916113282111;b",), ("&#" + "9" * 60 + ";",)], "c string")
    assert [r[0] for r in df.select(D.html_text(F.col("c")).column()).collect()] == ["a�b", "�"]
