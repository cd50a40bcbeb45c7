"""Naive Bayes by matrix against plain Python, and the guard inside the classifier."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from callwarden.config import AuditConfig
from callwarden.functions import trigrams
from callwarden.operators import bayes, learn
from callwarden.plans.classify import classify_calls

ODD = [
    None, "", "   ", "a", "$", "_9$", "ab", "ab cd", "$a$", "ÄÖ naïve zß", "x" * 40, "no\nnew\tlines", "中文 mixed中文ab",
    "a^b", "ends.", ".starts", "end", "start",
]


def plain_grams(text):
    found = []
    for token in re.findall(r"[a-z0-9_$]+", (text or "").lower()):
        framed = f"^{token}$"
        found += [framed[i : i + 3] for i in range(len(token))]
    return found


def in_batches(texts):
    names = trigrams.gram_texts()
    found = [Counter() for _ in texts]
    lowered = pa.array([None if t is None else t.lower() for t in texts], pa.string())
    for rows, codes in trigrams.positions(lowered):
        for row, code in zip(rows.tolist(), codes.tolist()):
            found[row][str(names[code])] += 1
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 19])
def test_trigrams_of_slices(monkeypatch, size):
    monkeypatch.setattr(trigrams, "SLICE", size)
    assert in_batches(ODD) == [Counter(plain_grams(t)) for t in ODD]


def test_sliced_arrow_arrays_and_no_texts():
    array = pa.array(["skip", "abc", None, "de"])[1:]
    rows = [r for part, _ in trigrams.positions(array) for r in part.tolist()]
    assert rows == [0, 0, 0, 2, 2]
    assert list(trigrams.positions(pa.array([], pa.string()))) == []
    assert list(trigrams.positions(pa.array([None, ""], pa.string()))) == []


def test_fold_is_crc32():
    folded = trigrams.fold(997)
    for code in random.Random(3).sample(range(trigrams.CODES), 200):
        assert folded[code] == zlib.crc32(str(trigrams.gram_texts()[code]).encode()) % 997


def brute(train, texts, alpha=0.2):
    counts, rows = defaultdict(Counter), Counter()
    for label, text in train:
        rows[label] += 1
        counts[label].update(zlib.crc32(g.encode()) % learn.BUCKETS for g in plain_grams(text))
    result = []
    for text in texts:
        best = None
        for label in sorted(rows):
            total = math.log(sum(counts[label].values()) + alpha * learn.BUCKETS)
            score = math.log((rows[label] + 1) / (len(train) + len(rows)))
            score += sum(
                math.log(counts[label][zlib.crc32(g.encode()) % learn.BUCKETS] + alpha) - total for g in plain_grams(text)
            )
            if best is None or score > best[1]:
                best = (label, score)
        result.append(best)
    return result


@pytest.fixture(scope="module")
def train():
    rng = random.Random(7)
    words = {"CAMERA": ["shoot", "lens", "Photo$1"], "SMS": ["inbox", "send_text", "sms9"], "NONE": ["draw", "tiles", "ui"]}
    return [(label, " ".join(rng.choices(words[label], k=rng.randint(0, 6)))) for label in rng.choices(list(words), k=90)]


def test_scores_equal_plain_python(spark, train):
    weights, classes = learn.nb_train(spark.createDataFrame(train, "data_type string, text string"), "data_type")
    texts = [*ODD, "Lens Photo$1", "tiles inbox", "send_text " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = brute(train, texts)
    for scored in (learn.nb_score(df, weights, classes), learn.nb_score_by_join(df, weights, classes)):
        got = {r["id"]: (r["label"], r["score"]) for r in scored.collect()}
        assert len(got) == len(texts)
        for i, (label, score) in enumerate(want):
            assert got[i][0] == label
            assert got[i][1] == pytest.approx(score, rel=1e-9)


def test_more_classes_than_a_broadcast_may_have(spark, train, monkeypatch):
    monkeypatch.setattr(bayes, "MAX_CLASSES", 2)
    weights, classes = learn.nb_train(spark.createDataFrame(train, "data_type string, text string"), "data_type")
    assert bayes.bayes_model(weights, classes, learn.BUCKETS) is None
    df = spark.createDataFrame([(1, "lens"), (2, "ui"), (3, None)], "id long, text string")
    guarded = {r["id"]: r["guard_type"] for r in learn.nb_guard(df, weights, classes).collect()}
    assert guarded[1] == "CAMERA" and guarded[2] is None
    with pytest.raises(ValueError):
        learn.train_guard(spark.createDataFrame(train, "data_type string, text string"))


def test_guard_stops_calls_that_would_pass_as_none(spark, tmp_path):
    framed = '[platform=miniprogram]\nstack: {}(x.js:1)\nparams: {{"consent_scope": [], "ts": "ok"}}'
    frames = {"NONE": "tiles.redraw", "CAMERA": "optics.trigger", "SMS": "outlet.flush"}
    learned = [(label, framed.format(frame)) for label, frame in frames.items() for _ in range(20)]
    model = learn.train_guard(spark.createDataFrame(learned, "data_type string, text string"))
    bayes.save_model(spark, model, str(tmp_path / "guard"))
    stored = bayes.load_model(spark, str(tmp_path / "guard"))
    assert stored.labels == model.labels and np.array_equal(stored.logp, model.logp)
    df = spark.createDataFrame([(i, framed.format(f)) for i, f in enumerate(frames.values())], "id long, text string")
    plain = {r["id"]: (r["combo"], r["review_reason"]) for r in classify_calls(df).collect()}
    assert plain == {i: ("NONE||COMPLIANT", None) for i in range(3)}
    guarded = {r["id"]: (r["combo"], r["review_reason"]) for r in classify_calls(df, AuditConfig(guard=stored)).collect()}
    assert guarded == {
        0: ("NONE||COMPLIANT", None),
        1: ("UNKNOWN||UNKNOWN", "dtype_guard_conflict:CAMERA"),
        2: ("UNKNOWN||UNKNOWN", "dtype_guard_conflict:SMS"),
    }
