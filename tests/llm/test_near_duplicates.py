"""Shingle join, components and the pipeline."""

import importlib
import random
import re

import pytest

from callwarden.llm import line_crf, line_dedup, sentencepiece_codec, shingle_join
from callwarden.llm.components import components

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if 0 < len(found) < words:
        return {tuple(found)}
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(pairs, sets)
    return {i: (len(sets[i]), found[i]) for i in sets}


def corpus():
    draw = random.Random(11)
    word = lambda: draw.choice(["the", "of", "and"]) if draw.random() < 0.3 else f"w{draw.randrange(4000)}"
    rows = []
    common = [word() for _ in range(60)]
    for base in range(40):
        text = [word() for _ in range(draw.choice([3, 5, 8, 20, 60, 200]))]
        if base % 3 == 0:
            text = common + text
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                at = draw.randrange(len(copy))
                copy[at : at + draw.choice([0, 1])] = [word()] * draw.choice([0, 1])
                copy = copy or ["x"]
            rows.append((len(rows), " ".join(copy) if draw.random() < 0.5 else "\n".join(copy).upper()))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 90)])
def test_components_match_all_pairs(docs, words, percent):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_documents(docs(rows), words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_a_chain_of_near_copies_is_one_component(docs):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i * 4] + [f"x{k}" for k in range(i * 4)] * 0 + [f"y{i}"] + words[i * 4 :])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_documents(docs(rows)).collect()}
    assert got == brute(rows, 4, 85)


def test_near_copies_about_the_threshold(docs):
    """Many variants of one text, most of them a little too far apart, and some that share their changes."""
    draw = random.Random(21)
    base = [f"w{draw.randrange(900)}" for _ in range(150)]
    rows = []
    for number in range(90):
        text = list(base)
        for _ in range(draw.choice([1, 2, 3, 4])):
            text[draw.randrange(len(text))] = draw.choice([f"n{number}", "a", "b"])
        if number % 3 == 0:
            text[40:44] = ["shared", "change", str(number % 2), "here"]
            text[90:91] = ["another", "one"]
        rows.append((number, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_documents(docs(rows)).collect()}
    want = brute(rows, 4, 85)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_odd_tables(spark, odd, empty):
    rows = shingle_join.similar_documents(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in rows if r.doc_id in (1, 2, 3)] == [r.doc_id for r in rows if r.doc_id in (1, 2, 3)]
    assert shingle_join.similar_documents(empty).collect() == []
    kept = shingle_join.near_duplicate_stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_texts_that_are_not_wanted_stay_in_their_task(spark):
    texts = spark.range(-2000, 2000).selectExpr("id as doc_id", "xxhash64(id) as version", "concat('text ', id) as text")
    wanted = texts.where("doc_id % 40 = 7").selectExpr("doc_id as c", "doc_id", "version")
    found = {r.doc_id for r in shingle_join.likely(texts, wanted).collect()}
    assert {d for d in range(-2000, 2000) if d % 40 == 7 and d > 0} <= found
    assert {r.doc_id for r in wanted.collect()} <= found and len(found) <= 110
    assert shingle_join.likely(texts, wanted.where("false")).count() == 0
    table = shingle_join.member_table(wanted, texts.select("doc_id", "text"), 2)
    assert table.count() == 0  # other versions: the join after the bitmap is exact


def test_similar_sets_share_a_key_that_is_not_weak():
    import numpy as np

    draw = np.random.default_rng(12)
    for _ in range(300):
        size = int(draw.choice([1, 2, 5, 7, 12, 40, 300]))
        a = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[int(draw.integers(0, size // 12 + 1)) :], draw.integers(0, 1 << 63, int(draw.integers(0, size // 12 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            keys = [set(np.concatenate([k for _, k in shingle_join.sketch(x, 85)]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_star_contraction(spark):
    draw = random.Random(13)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    nodes = {n for p in pairs for n in p}
    got = {n: n for n in nodes} | {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_against_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    field = line_crf.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in line_crf.apply_field(table, field).collect() if r.predicted}
    rows = sorted((r.doc_id, r.text) for r in table.collect() if r.doc_id in good)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    owner = {}
    for doc_id, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= line_dedup.MIN_CHARS:
                owner.setdefault(key(line), doc_id)
    rows = [(d, "\n".join(x for x in t.split("\n") if owner.get(key(x), d) == d)) for d, t in rows]
    group = brute(rows, 5, 80)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    squeeze = lambda t: " ".join(t.split())
    items = [squeeze(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(i in squeeze(t) for i in items)]
    got = {r.doc_id: list(r.ids) for r in pipeline.run(spark, sf).collect()}
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    missing = {d for d, _ in rows} - got.keys()
    assert got.keys() <= {d for d, _ in rows} and len(missing) <= 0.02 * len(rows)  # part of an item may be left of its lines
    assert all(got[d] == library.encode(t) for d, t in rows if d in got)
