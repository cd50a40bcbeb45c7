"""Quality rules: boosted trees over document statistics, scored as flat node arrays.

Exact counts of whole texts (``text_stats``) give both the base rule and the features. The trees
are grown in numpy on a bounded sample of labelled documents (``SAMPLE``), with monotonic
constraints: more symbols, repeated words or repeated lines never raise a score. Scoring walks
all trees of a block of documents at once through node arrays.

Defined cases: NULL or empty texts have zero words and fail the base rule. Without labels of both
kinds the trees are empty and only the base rule decides. Rows with a NULL label or id teach
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import blocks, column_bytes, doc_crc, documents, map_arrow
from callwarden.llm.text_stats import counts

#: Most labelled documents that the trees are grown on, in order of a hash of the id.
SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
KEEP_AT = 0.5
#: Name and constraint of each feature: -1 means that a higher value never raises the score.
FEATURES = [
    ("symbols per character", -1), ("repeated words per word", -1), ("repeated lines per line", -1),
    ("words that repeat the one before, per word", -1), ("words that end in a symbol, per word", -1),
    ("exclamation marks per word", -1), ("distinct words per word", 0), ("upper-case letters per letter", 0),
    ("digits per character", 0), ("letters per character", 0), ("characters per word", 0),
    ("punctuation per word", 0), ("characters per line", 0), ("log of words", 0),
]
SIGNS = np.array([sign for _, sign in FEATURES])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    per = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.column_stack([
        per("n_symbols", "n_chars"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"),
        per("n_follow", "n_words"), per("n_symbol_ends", "n_words"), per("n_exclaims", "n_words"),
        per("n_distinct", "n_words"), per("n_upper", "n_letters"), per("n_digits", "n_chars"),
        per("n_letters", "n_chars"), per("word_chars", "n_words"), per("n_marks", "n_words"),
        per("n_chars", "n_lines"), np.log1p(c["n_words"]),
    ])


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; a leaf has feature -1 and points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.bias)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, np.maximum(self.feature[node], 0)] <= self.limit[node]
            node = np.where(self.feature[node] < 0, node, np.where(below, self.low[node], self.high[node]))
        return self.bias + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS, trees: int = 60, depth: int = 4,
    rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0,
) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    nodes: list[list] = []
    roots: list[int] = []
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) == 2:
        limits = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        codes = [np.searchsorted(limit, f, "left") for limit, f in zip(limits, x.T, strict=True)]
        margin = np.full(len(y), bias)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = weight * (p - y), weight * p * (1 - p)
            roots.append(len(nodes))
            _grow_node(nodes, np.arange(len(y)), slope, curve, limits, codes, signs, (-np.inf, np.inf), depth, rate, ridge, least, margin)
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth, bias)


def _grow_node(nodes, rows, slope, curve, limits, codes, signs, bounds, depth, rate, ridge, least, margin) -> int:
    """Append the node over ``rows`` and those below it; add the leaves to ``margin``."""
    me = len(nodes)
    g, h = slope[rows], curve[rows]
    value = float(np.clip(-g.sum() / (h.sum() + ridge), *bounds))
    nodes.append([-1, 0.0, me, me, rate * value])
    best = (1e-6, None)
    for f, limit in enumerate(limits) if depth else ():
        if not len(limit):
            continue
        gl = np.cumsum(np.bincount(codes[f][rows], g, len(limit) + 1))[:-1]
        hl = np.cumsum(np.bincount(codes[f][rows], h, len(limit) + 1))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        wl, wr = np.clip(-gl / (hl + ridge), *bounds), np.clip(-gr / (hr + ridge), *bounds)
        gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2)
        gain += g.sum() * value + 0.5 * (h.sum() + ridge) * value**2
        gain[(hl * 4 < least) | (hr * 4 < least) | (signs[f] * (wr - wl) < 0)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
    if best[1] is None:
        margin[rows] += rate * value
        return me
    f, k, wl, wr = best[1]
    middle = (wl + wr) / 2
    below = codes[f][rows] <= k
    low = (bounds[0], middle) if signs[f] > 0 else (middle, bounds[1]) if signs[f] < 0 else bounds
    high = (middle, bounds[1]) if signs[f] > 0 else (bounds[0], middle) if signs[f] < 0 else bounds
    rest = (slope, curve, limits, codes, signs)
    nodes[me][:4] = [
        f, limits[f][k],
        _grow_node(nodes, rows[below], *rest, low, depth - 1, rate, ridge, least, margin),
        _grow_node(nodes, rows[~below], *rest, high, depth - 1, rate, ridge, least, margin),
    ]
    return me


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, quality) of at most ``most`` labelled documents outside the held-out fold.

    The bound makes the broadcast safe. Labels of one id that disagree count as 0.
    """
    known = labels.where("doc_id is not null and quality is not null").where(doc_crc() % folds != held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        x = features(counts(*column_bytes(block.column("text"))))
        columns = [block.column("doc_id"), block.column("quality"), pa.array(list(x), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Trees:
    """Trees from a bounded labelled sample; only its feature rows reach the driver."""
    sample = labelled_sample(docs, labels, most, folds, held_out)
    sample = sample.select("doc_id", "text", F.col("quality").cast("int"))
    rows = map_arrow(sample, _sample_features, "doc_id long, quality int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows.column("doc_id").to_numpy()))
    return grow(x[order], (rows.column("quality").to_numpy() == 1).astype(float)[order])


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def apply_rules(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, base rule, tree score and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            c = counts(*column_bytes(block.column("text")))
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            score = trees.score(features(c))
            numbers = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *numbers, pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, RESULT)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op10_quality_rules": (op10_quality_rules, None)}
