"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. Its potentials come from statistics of the line and of the
lines before and after it; transitions tie neighbouring labels. Forward and backward messages of
all lines of a block are products of 2 x 2 matrices, taken by a doubling scan, so a document of a
million lines costs twenty vectorised rounds. A document's quality is the mean marginal of "good",
weighted by line length, put on the scale of the labels by a logistic fit.

The field is trained in numpy by gradient descent on the expected minus the observed feature counts of a
bounded sample of labelled documents outside the held-out fold (``SAMPLE`` documents of at most
``SAMPLE_LINES`` lines each), whose lines carry the label of their document.

Defined cases: NULL or empty text is one empty line and is scored like any other. Without labels
of both kinds every score is the share of good labels, or 1 without any label, so that nothing
is rejected unlearned. Rows with a NULL label or id teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import blocks, code_points, column_bytes, doc_crc, documents, map_arrow, owners, span_hashes, word_spans
from callwarden.llm.quality_rules import labelled_sample
from callwarden.llm.text_stats import DIGITS, LETTERS, MARKS, SYMBOLS, UPPERCASE, line_spans, repeats

SAMPLE, SAMPLE_LINES = 2000, 1000
FOLDS, HELD_OUT = 4, 2
GOOD_AT = 0.7
#: Statistics of one line; the field sees each of them and its square, here, before and after.
STATISTICS = 13
WIDTH = 3 * (2 * STATISTICS + 1)


def line_statistics(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of every line, line lengths in characters, first line of each document)."""
    starts, ends, first = line_spans(data, edges)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[starts]

    word_start, word_end, _ = word_spans(data, edges)
    low, high = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    words = high - low
    line_of_word = np.repeat(np.arange(len(starts)), words)
    hashes = span_hashes(data, word_start, word_end, fold=True)
    seen, _ = repeats(hashes, line_of_word)
    follow = np.zeros(len(hashes), bool)
    follow[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    last = data[word_end - 1] if len(word_end) else np.empty(0, np.uint8)

    def of_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[high] - sums[low]

    length, letters = total(code_points(data)), total(LETTERS[data])
    chars, w = np.maximum(length, 1), np.maximum(words, 1)
    final = np.zeros(len(starts), bool)
    full = np.flatnonzero(words)
    final[full] = np.isin(last[high[full] - 1], [ord(c) for c in ".!?"])
    table = np.column_stack([
        np.log1p(words), length / w, total(SYMBOLS[data]) / chars, of_words(SYMBOLS[last]) / w,
        total(UPPERCASE[data]) / np.maximum(letters, 1), total(data == ord("!")) / w, total(DIGITS[data]) / chars,
        letters / chars, total(MARKS[data]) / w, 1 - of_words(seen) / w, of_words(follow) / w, final, words == 0,
    ])
    return table.astype(np.float32), length, first


def neighbourhood(scaled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of every line: its own, those before and those after, each with a presence flag."""
    own = np.column_stack([scaled, scaled**2 - 1, np.ones(len(scaled))])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack([own, before, after])


def _scan(matrices: np.ndarray, longest: int) -> np.ndarray:
    """Running products from the left of at least ``longest`` factors each, up to scale."""
    out, reach = matrices.copy(), 1
    while reach < longest:
        product = out[:-reach] @ out[reach:]
        product /= product.max(axis=(1, 2), keepdims=True)
        out[reach:] = product
        reach *= 2
    return out


def marginals(emission: np.ndarray, start: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(label) of each line, P(label before, label) of each line but a document's first).

    ``emission`` is lines x 2, ``start`` 2 and ``step`` 2 x 2 log potentials. A document's first
    factor has equal rows and its last backward factor is constant, which cuts the chain there.
    """
    lines, longest = len(emission), int(np.diff(first).max(initial=1))
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    jump = np.exp(step - step.max())
    forward = jump[None] * local[:, None, :]
    forward[first[:-1]] = (np.exp(start - start.max()) * local[first[:-1]])[:, None, :]
    alpha = _scan(forward, longest)[:, 0, :]
    alpha /= alpha.sum(axis=1, keepdims=True)
    backward = np.ones((lines, 2, 2))
    backward[:-1] = jump[None] * local[1:, None, :]
    backward[first[1:] - 1] = 1
    # suffix products are prefix products of the reversed, transposed factors
    beta = _scan(backward[::-1].transpose(0, 2, 1), longest)[::-1].transpose(0, 2, 1).sum(axis=2)
    beta /= beta.sum(axis=1, keepdims=True)
    node = alpha * beta
    node /= np.maximum(node.sum(axis=1, keepdims=True), 1e-300)
    pair = np.zeros((lines, 2, 2))
    pair[1:] = alpha[:-1, :, None] * jump[None] * (local[1:] * beta[1:])[:, None, :]
    pair[first[:-1]] = 0
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return node, pair


@dataclass
class Field:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # features -> log potential of "good" over "bad"
    start: np.ndarray
    step: np.ndarray
    fit: tuple[float, float]  # logit of the weighted marginal -> logit of the score
    constant: float | None = None  # score of all documents if nothing was learnt

    def features(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        return neighbourhood(np.clip((table - self.centre) / self.spread, -4, 4), first)

    def lines(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        good = np.clip(self.features(table, first) @ self.weights, -30, 30)
        return marginals(np.column_stack([np.zeros(len(good)), good]), self.start, self.step, first)[0][:, 1]

    def score(self, table: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of every document."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        logit = _logit(_weighted(self.lines(table, first), length, first))
        return 1 / (1 + np.exp(-(self.fit[0] * logit + self.fit[1])))


def _weighted(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean over a document's lines, weighted by length plus one."""
    weight = length + 1.0
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(table: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> Field:
    """Field from documents with 0/1 labels."""
    nothing = Field(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(WIDTH), np.zeros(2), np.zeros((2, 2)), (1.0, 0.0))
    if len(set(label.tolist())) < 2:
        nothing.constant = float(label.mean()) if len(label) else 1.0
        return nothing
    field = nothing
    field.centre, field.spread = table.mean(axis=0), table.std(axis=0) + 1e-3
    x = field.features(table, first)
    line_label = label[owners(first)]
    share = label.mean()
    doc_weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / np.diff(first) ** 0.5
    weight = doc_weight[owners(first)]
    weight /= weight.sum()
    seen = np.zeros((len(x), 2))
    seen[np.arange(len(x)), line_label] = 1
    seen_pair = np.zeros((len(x), 2, 2))
    seen_pair[np.arange(len(x)), line_label, line_label] = 1
    seen_pair[first[:-1]] = 0
    values = [field.weights, field.start, field.step]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for turn in range(1, rounds + 1):
        good = np.clip(x @ values[0], -30, 30)
        node, pair = marginals(np.column_stack([np.zeros(len(x)), good]), values[1], values[2], first)
        heads = first[:-1]
        slopes = [
            x.T @ (weight * (node - seen)[:, 1]) + ridge * values[0],
            (weight[heads, None] * (node - seen)[heads]).sum(axis=0) + ridge * values[1],
            (weight[:, None, None] * (pair - seen_pair)).sum(axis=0) + 0.02 * values[2],
        ]
        for k, (value, slope) in enumerate(zip(values, slopes, strict=True)):
            m, v = moments[k]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    logit = _logit(_weighted(field.lines(table, first), length, first))
    field.fit = _logistic(logit, label)
    return field


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic regression with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        curve = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        da, db = np.clip(np.linalg.solve(curve, grad), -1, 1)
        a, b = max(a - da, 0.05), b - db
    return float(a), float(b)


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        table, length, first = line_statistics(*column_bytes(block.column("text")))
        cut = lambda values: pa.array([values[a:b].ravel() for a, b in zip(first[:-1], first[1:], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("quality"), cut(table).cast(pa.list_(pa.float32())), cut(length).cast(pa.list_(pa.int64()))],
            names=["doc_id", "quality", "stats", "lengths"],
        )


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_lines: int = SAMPLE_LINES, folds: int = FOLDS, held_out: int = HELD_OUT) -> Field:
    """Field from a bounded labelled sample; only its line statistics reach the driver."""
    sample = labelled_sample(docs, labels, most, folds, held_out)
    sample = sample.where(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < most_lines)
    sample = sample.select("doc_id", "text", F.col("quality").cast("int"))
    rows = map_arrow(sample, _sample_lines, "doc_id long, quality int, stats array<float>, lengths array<long>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    lengths = [np.asarray(r.values) for r in rows.column("lengths")]
    if not lengths:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0), np.zeros(1, int), np.zeros(0, int))
    table = np.concatenate([np.asarray(r.values) for r in rows.column("stats")]).reshape(-1, STATISTICS).astype(float)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lengths])])
    return fit(table, np.concatenate(lengths), first, (rows.column("quality").to_numpy() == 1).astype(int))


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def scores(texts: pa.Array, field: Field) -> np.ndarray:
    return field.score(*line_statistics(*column_bytes(texts)))


def apply_field(docs: DataFrame, field: Field, good_at: float = GOOD_AT, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Score and prediction of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score = scores(block.column("text"), field)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(score), pa.array((score >= good_at).astype(np.int32))],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    fold = F.coalesce(doc_crc() % folds == held_out, F.lit(False))
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", fold.alias("held_out")), run, RESULT)


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, good: P(good) of every line in order) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            table, _, first = line_statistics(*column_bytes(block.column("text")))
            good = field.lines(table, first)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(good))], names=["doc_id", "good"]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, good array<double>")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_field(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns."""
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(scores(block.column("text"), field) >= GOOD_AT))

    return map_arrow(docs, run, docs.schema)


QUERIES = {"op4_line_crf": (op4_line_crf, None)}
