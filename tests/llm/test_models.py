"""Line field, boosted trees and language ID: exact parts by brute force, learning by held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from callwarden.llm import language_id, line_crf, quality_rules
from callwarden.llm.common import column_bytes
from callwarden.llm.text_stats import counts

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# ---------------------------------------------------------------- line field


def test_marginals_match_enumeration():
    draw = np.random.default_rng(3)
    first = np.array([0, 1, 5, 11])
    emission, start, step = draw.normal(0, 2, (11, 2)), draw.normal(0, 1, 2), draw.normal(0, 1, (2, 2))
    node, pair = line_crf.marginals(emission, start, step, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, want, want_pair = 0.0, np.zeros((b - a, 2)), np.zeros((b - a, 2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(start[path[0]] + sum(emission[a + i, k] for i, k in enumerate(path)) + sum(step[x, y] for x, y in itertools.pairwise(path)))
            total += weight
            for i, k in enumerate(path):
                want[i, k] += weight
                if i:
                    want_pair[i, path[i - 1], k] += weight
        assert np.allclose(node[a:b], want / total) and np.allclose(pair[a:b], want_pair / total)


def test_line_field_tells_held_out_documents(spark):
    got = {r.doc_id: r for r in line_crf.op4_line_crf(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == 1000 and all(r.held_out == (fold(d, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_line_field_scores_do_not_depend_on_blocks(spark, odd):
    field = line_crf.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [t for _, t in ODD]
    together = line_crf.scores(pa.array(texts), field)
    assert np.allclose(together, [line_crf.scores(pa.array([t], pa.string()), field)[0] for t in texts])
    rows = line_crf.line_labels(odd, field).collect()
    assert sorted(len(r.good) for r in rows) == sorted(len((t or "").split("\n")) for t in texts)


def test_line_field_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    field = line_crf.train(odd, none)
    assert {r.predicted for r in line_crf.apply_field(odd, field).collect()} == {1}
    assert line_crf.apply_field(empty, field).collect() == []


# ---------------------------------------------------------------- rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, marked = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_counts_match_brute_force():
    draw = random.Random(2)
    texts = [t for _, t in ODD] + ["".join(draw.choice(["a", "b ", "é", "\n", "# ", " ", "x\ny", "\x0b", "a b c d e f g h "]) for _ in range(draw.randrange(80))) for _ in range(500)]
    c = counts(*column_bytes(pa.array(texts)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(c[n][i]) for n in names) for i in range(len(texts))] == [brute(t) for t in texts]


def test_trees_keep_their_constraints_and_learn():
    draw = np.random.default_rng(4)
    x = draw.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] - 2 * x[:, 1] + x[:, 2] ** 2 + draw.normal(0, 0.2, 3000) > 0).astype(float)
    trees = quality_rules.grow(x, y, np.array([1, -1, 0]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.93
    line = np.linspace(-1, 1, 200)
    for base in draw.uniform(-1, 1, (30, 3)):
        for f, sign in ((0, 1), (1, -1)):
            points = np.tile(base, (200, 1))
            points[:, f] = line
            assert (np.diff(trees.margin(points)) * sign >= -1e-9).all()


def test_flat_nodes_score_like_a_walk():
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(400, 14)), draw.integers(0, 2, 400).astype(float)
    trees = quality_rules.grow(x, y, trees=7, depth=3)

    def walk(node, row):
        while trees.feature[node] >= 0:
            node = trees.low[node] if row[trees.feature[node]] <= trees.limit[node] else trees.high[node]
        return trees.value[node]

    assert np.allclose(trees.margin(x), [trees.bias + sum(walk(r, row) for r in trees.roots) for row in x])


def test_rules_on_held_out_documents_and_odd_texts(spark, odd, empty):
    got = {r.doc_id: r for r in quality_rules.op10_quality_rules(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc_id, r in got.items():
        words, chars, symbols, dup, repeat = brute(texts[doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeat)
        assert r.base_failed == (words < 20 or 100 * repeat > 30 * words) and not (r.base_failed and r.kept)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if fold(r.doc_id, 4) == 2]
    assert np.mean([(got[r.doc_id].score >= 0.5) == r.quality for r in labels]) > 0.97
    none = quality_rules.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert len(quality_rules.apply_rules(odd, none).collect()) == len(ODD) and quality_rules.apply_rules(empty, none).collect() == []


# ---------------------------------------------------------------- language


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language_id.op9_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean(held) > 0.98


def test_language_of_odd_texts(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, per_language=50)
    got = {r.doc_id: r for r in language_id.apply_model(odd.where("doc_id != 5"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[6].lang_pred != "und"
    assert language_id.apply_model(empty, model).collect() == []
    texts = [t for _, t in ODD if t]
    together = model.probabilities(*column_bytes(pa.array(texts)))
    assert np.allclose(together, [model.probabilities(*column_bytes(pa.array([t])))[0] for t in texts])
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.apply_model(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("size", language_id.SIZES)
def test_subwords_stay_in_their_document(size):
    data, edges = column_bytes(pa.array(["abc", "", "a", "defgh"]))
    bucket, first = language_id.subwords(data, edges)[language_id.SIZES.index(size)]
    assert np.diff(first).tolist() == [max(n - size + 1, 0) for n in (3, 0, 1, 5)] and len(bucket) == first[-1]
