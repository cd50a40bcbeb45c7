"""Language ID: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of ``SIZES`` bytes of the text with A-Z lower-cased and every other ASCII
non-letter turned into a space, so they lie within a word or at its edges. Each subword is hashed
to a row of an embedding table; a text is the mean of its rows, and a linear softmax gives the
language. Table and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample (``PER_LANGUAGE`` documents of each language, ``SAMPLE`` in all), the temperature
and the rejection limit on a part of the sample that the descent didn't see. As both layers are
linear, scoring looks up one row of (table x softmax) for each subword.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0. A text whose score
is below the calibrated limit keeps its language and is marked ``rejected``. Without any labelled
document every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.llm.common import FOLD, blocks, column_bytes, doc_crc, documents, map_arrow

SIZES = (2, 3, 4)
BUCKETS = 1 << 14
WIDTH = 12
#: Most training documents of one language, and in all; chosen by a hash of the id.
PER_LANGUAGE, SAMPLE = 800, 4000
#: Parts that a language is drawn from, so that a frequent one isn't ranked in one task.
DRAWS = 64
FOLDS, HELD_OUT = 5, 0
#: Share of right answers wanted among the texts that aren't rejected.
PRECISION = 0.99
UNKNOWN = "und"

_SPACED = FOLD.copy()
for _c in range(128):
    if not chr(_c).isalpha():
        _SPACED[_c] = 32
_LETTER = np.zeros(256, bool)
for _c in range(128):
    _LETTER[_c] = chr(_c).isalpha()


def subwords(data: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (bucket at every byte, first bucket of each document and of the end).

    Documents shorter than a size have none of it; runs never cross documents.
    """
    folded = _SPACED[data].astype(np.uint32)
    out = []
    for size in SIZES:
        count = max(len(data) - size + 1, 0)
        code = np.full(count, 2166136261 + size, np.uint32)
        for k in range(size):
            code = (code ^ folded[k : k + count]) * np.uint32(16777619)
        code ^= code >> np.uint32(15)
        bucket = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        keep = np.ones(count, bool)
        for k in range(1, size):  # runs that begin less than a size before the end of a document
            at = edges[1:] - k
            keep[at[(at >= 0) & (at < count)]] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        out.append((bucket[keep], before[np.minimum(edges, count)]))
    return out


def has_letter(data: np.ndarray, edges: np.ndarray, texts) -> np.ndarray:
    """Whether each text has a letter; texts without an ASCII letter are asked one by one."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = seen[edges[1:]] > seen[edges[:-1]]
    for i in np.flatnonzero(~found & (np.diff(edges) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding rows times the softmax weights
    bias: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        docs, total = len(edges) - 1, np.zeros(len(edges) - 1)
        sums = np.zeros((docs, len(self.languages)))
        for bucket, first in subwords(data, edges):
            total += np.diff(first)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                sums[some] += np.add.reduceat(self.table[bucket], first[some], axis=0)
        logits = (sums / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], names: list[str], rounds: int = 12, batch: int = 32, rate: float = 6.0, seed: int = 7) -> Model:
    """Descent over bags (buckets, counts); every fifth bag only calibrates."""
    languages = sorted(set(names))
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0, 0.0)
    draw = np.random.default_rng(seed)
    labels = np.array([languages.index(n) for n in names])
    rows, weight = [b for b, _ in bags], [c / max(c.sum(), 1) for _, c in bags]
    embed = draw.normal(0, 0.5 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    probe = np.arange(4, len(bags), 5) if len(bags) >= 50 else np.arange(len(bags))
    learn = np.setdiff1d(np.arange(len(bags)), probe) if len(bags) >= 50 else probe
    share = len(learn) / (len(languages) * np.maximum(np.bincount(labels[learn], minlength=len(languages)), 1))
    out += draw.normal(0, 0.5, out.shape)
    steps = max(rounds * -(-len(learn) // batch), 1)
    step = 0
    for _ in range(rounds):
        order = draw.permutation(learn)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            dense = np.zeros((len(some), BUCKETS))
            for k, i in enumerate(some):
                dense[k, rows[i]] = weight[i]
            mean = dense @ embed
            error = softmax(mean @ out + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            error *= share[labels[some]][:, None] / len(some)
            now = rate * (1 - step / steps)
            back = error @ out.T
            out -= now * mean.T @ error
            bias -= now * 0.1 * error.sum(axis=0)
            embed -= now * 4 * (dense.T @ back)
            step += 1
    table = (embed @ out).astype(np.float32)
    logits = np.array([weight[i] @ table[rows[i]] + bias for i in probe])
    truth = labels[probe]
    scales = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(probe)), truth], 1e-12)).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    return Model(languages, table, bias, temperature, _limit(softmax(logits / temperature), truth))


def _limit(p: np.ndarray, truth: np.ndarray) -> float:
    """Lowest score above which the wanted share of answers is right."""
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        data, edges = column_bytes(block.column("text"))
        found = subwords(data, edges)
        bags = [np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in found]), return_counts=True) for i in range(block.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("lang"), pa.array([b for b, _ in bags], pa.list_(pa.int32())), pa.array([c for _, c in bags], pa.list_(pa.int32()))],
            names=["doc_id", "lang", "buckets", "times"],
        )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Model from a bounded sample outside the held-out fold; its subword counts reach the driver."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(doc_crc() % folds != held_out)
    known = known.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("draw"))
    order = Window.partitionBy("lang", F.pmod("draw", F.lit(DRAWS))).orderBy("draw", "doc_id")
    each = -(-per_language // DRAWS)
    chosen = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    chosen = chosen.orderBy("rank", "draw", "doc_id").limit(most).select("doc_id", "lang").distinct()
    sample = docs.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = map_arrow(sample, _bags, "doc_id long, lang string, buckets array<int>, times array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    bags = [(r.values.to_numpy(), c.values.to_numpy()) for r, c in zip(rows.column("buckets"), rows.column("times"), strict=True)]
    return fit(bags, rows.column("lang").to_pylist())


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def apply_model(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Language, calibrated score and rejection of every document."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column("text")
            data, edges = column_bytes(texts)
            known = has_letter(data, edges, texts) & bool(model.languages)
            p = model.probabilities(data, edges) if model.languages else np.zeros((block.num_rows, 1))
            score = np.where(known, p.max(axis=1), 0.0)
            best = np.where(known, p.argmax(axis=1), len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(score < model.limit)],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    fold = F.coalesce(doc_crc() % folds == held_out, F.lit(False))
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", fold.alias("held_out")), run, RESULT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_model(docs, train(docs))


QUERIES = {"op9_language_id": (op9_language_id, None)}
