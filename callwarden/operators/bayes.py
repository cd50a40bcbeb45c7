"""Naive Bayes over trigrams as one bounded matrix, scored inside the row.

Trigrams have fewer than 60,000 codes (``functions/trigrams.py``), so a model is classes x codes
numbers whatever it learned from. It is broadcast once its number of classes is checked, and a text
meets it in an Arrow function without any exchange. More classes than ``MAX_CLASSES`` are scored by a
join instead (``learn.nb_score``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.functions import trigrams
from callwarden.session import ship_package

#: Classes that a broadcast model may have: 256 x 59,319 doubles are 122 MB.
MAX_CLASSES = 256
#: Multiples of 1 / UNIT add up without rounding to 2 ** 53 / UNIT, far beyond the score of any text.
UNIT = float(1 << 24)


@dataclass(frozen=True)
class BayesModel:
    """``labels`` ascending (an unlabelled class last), ``prior`` (classes), ``logp`` (classes, codes)."""

    labels: tuple
    prior: np.ndarray
    logp: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """(texts, classes): prior plus the log-probabilities of all trigrams of the whole text.

        Weights are added in two parts, the first of them without any rounding: added one by one, the
        100,000 weights of a long text lose up to 1e-7, enough to round a score another way.
        """
        whole, rest = np.zeros((len(texts), len(self.prior))), np.tile(self.prior, (len(texts), 1))
        for rows, codes in trigrams.positions(texts):
            low, high = int(rows[0]), int(rows[-1]) + 1
            for k, weights in enumerate(self.logp):
                coarse = np.round(weights * UNIT) / UNIT
                whole[low:high, k] += np.bincount(rows - low, coarse[codes], high - low)
                rest[low:high, k] += np.bincount(rows - low, (weights - coarse)[codes], high - low)
        return whole + rest

    def best(self, texts: pa.Array) -> pa.StructArray:
        """Struct (label, score) of the best class; ties by the smaller label."""
        total = self.scores(texts)
        at = total.argmax(axis=1)
        labels = pa.array(self.labels, pa.string()).take(pa.array(at))
        return pa.StructArray.from_arrays(
            [labels, pa.array(total[np.arange(len(at)), at])], names=["label", "score"]
        )


def bayes_model(weights: DataFrame, classes: DataFrame, buckets: int | None) -> BayesModel | None:
    """The tables of ``learn.nb_train`` as a matrix; None beyond ``MAX_CLASSES``.

    The driver gets at most ``MAX_CLASSES`` rows of classes and one row of weights for each class and
    trigram (or bucket), a bound that holds for any amount of training data.
    """
    known = classes.select("label", "prior", "unseen").limit(MAX_CLASSES + 1).collect()
    if len(known) > MAX_CLASSES:
        return None
    known.sort(key=lambda r: (r["label"] is None, r["label"]))
    place = {r["label"]: k for k, r in enumerate(known)}
    width = buckets or trigrams.CODES
    logp = np.repeat(np.array([r["unseen"] for r in known], float)[:, None], width, axis=1)
    rows = weights.select("label", "gram", "logp").filter("label is not null").toArrow()
    if buckets:
        gram = rows["gram"].to_numpy().astype(np.int64)
    else:
        code = {g: i for i, g in enumerate(trigrams.gram_texts().tolist())}
        gram = np.array([code[g] for g in rows["gram"].to_pylist()], np.int64)
    label = rows["label"].combine_chunks().dictionary_encode()
    at = np.array([place[v] for v in label.dictionary.to_pylist()], np.int64)
    if len(gram):
        logp[at[label.indices.to_numpy()], gram] = rows["logp"].to_numpy()
    if buckets:
        logp = logp[:, trigrams.fold(buckets)]
    return BayesModel(tuple(place), np.array([r["prior"] for r in known], float), logp)


def best_class(spark: SparkSession, model: BayesModel, text: str = "text") -> Column:
    """Struct (label, score) of every text; one without trigrams gets the likeliest class."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def best(texts: pa.Array) -> pa.Array:
        return shared.value.best(texts)

    return F.arrow_udf(best, "label string, score double")(F.lower(F.col(text)))


def guard_type(spark: SparkSession, model: BayesModel, text: str = "text", none: str = "NONE") -> Column:
    """Type that the model sees in a text, NULL for ``none`` and for NULL texts."""
    label = best_class(spark, model, text)["label"]
    return F.when(F.col(text).isNotNull(), F.nullif(label, F.lit(none)))


def save_model(spark: SparkSession, model: BayesModel, path: str) -> None:
    """Write a model as one row for each class."""
    rows = [
        (k, label, float(p), w.tolist())
        for k, (label, p, w) in enumerate(zip(model.labels, model.prior, model.logp))
    ]
    schema = "place int, label string, prior double, logp array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> BayesModel:
    """Read a model that ``save_model`` wrote."""
    rows = spark.read.parquet(path).orderBy("place").collect()
    return BayesModel(
        tuple(r["label"] for r in rows),
        np.array([r["prior"] for r in rows], float),
        np.array([r["logp"] for r in rows], float).reshape(len(rows), trigrams.CODES),
    )
