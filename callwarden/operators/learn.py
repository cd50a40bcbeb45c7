"""Models trained and applied as Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwarden import vocab
from callwarden.functions import calls, trigrams
from callwarden.functions.consts import strings
from callwarden.operators import bayes
from callwarden.session import cut_lineage, ship_package

BUCKETS = 65_536
MISSING = "<MISSING>"


# --- features ----------------------------------------------------------------------------
def char_trigrams(text: Column) -> Column:
    """Trigrams of ``^token$`` over a whole lower-cased text."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_$]+"), F.lit(0))
    grams = F.transform(
        tokens,
        lambda t: F.transform(
            F.sequence(F.lit(1), F.length(t)),
            lambda i: F.substring(F.concat(F.lit("^"), t, F.lit("$")), i, F.lit(3)),
        ),
    )
    return F.flatten(grams)


def dtype_features(text: Column, stack: Column, body: Column) -> Column:
    """``plat=``, ``api=``, ``cls=`` and ``key=`` tokens of one call."""
    frames = F.regexp_extract_all(
        stack, F.lit(r"(?U)(?:at\s+|<- |stack: )([A-Za-z_][\w.$]*\.[A-Za-z_]\w*)\s*\("), F.lit(1)
    )
    classes = F.transform(frames, lambda f: F.substring_index(F.substring_index(f, ".", -2), ".", 1))
    keys = F.coalesce(
        F.array_except(F.json_object_keys(body), strings(vocab.SIGNAL_KEYS)),
        F.array().cast("array<string>"),
    )
    tag = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name + "="), v))
    platform = F.coalesce(
        calls.blank_to_null(F.regexp_extract(text, r"\[platform=([a-z]+)\]", 1)), F.lit("?")
    )
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("plat="), platform)),
            tag("api", frames),
            tag("cls", classes),
            tag("key", keys),
        )
    )


def signal_text(key: str) -> Column:
    """Signal as text for encoding; lists sorted and joined, absent as a marker."""
    value = F.col(f"raw.{key}")
    listed = F.expr(f"try_variant_get(raw.{key}, '$', 'array<string>')")
    plain = F.when(
        F.schema_of_variant(value).startswith("ARRAY"), F.array_join(F.array_sort(listed), "|")
    ).otherwise(value.cast("string"))
    return F.when(F.array_contains("present", F.lit(key)), F.coalesce(plain, F.lit("<NULL>"))).otherwise(
        MISSING
    )


def signal_features() -> Column:
    """``key=value`` tokens of all signals."""
    return F.array(*[F.concat(F.lit(k + "="), signal_text(k)) for k in vocab.SIGNAL_KEYS])


def scope_vector() -> Column:
    """One indicator per personal type: 1 listed, 0 not listed, 2 scope missing."""
    listed = F.coalesce(
        F.expr("try_variant_get(raw.consent_scope, '$', 'array<string>')"),
        F.array(F.col("raw.consent_scope").cast("string")),
    )
    missing = ~F.array_contains("present", F.lit("consent_scope"))
    return F.transform(
        strings(vocab.PERSONAL_TYPES),
        lambda t: F.when(missing, 2).when(F.array_contains(listed, t), 1).otherwise(0),
    )


def signal_encoder(df: DataFrame) -> DataFrame:
    """(field, value, n, code): all values of each scalar signal, coded by rank of frequency.

    Ties go by value. Ranks are counted inside sorted ranges and added up over the ranges before, so
    no task holds all values of a field.
    """
    fields = [k for k in vocab.SIGNAL_KEYS if k != "consent_scope"]
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("field"), signal_text(k).alias("value")) for k in fields])
        ).alias("p")
    ).select("p.*")
    counts = pairs.groupBy("field", "value").agg(F.count("*").alias("n"))
    return rank_in_field(counts)


def rank_in_field(counts: DataFrame) -> DataFrame:
    """Add ``code``: the place of a row (field, value, n) in its field, the largest ``n`` first."""
    ranged = counts.repartitionByRange("field", F.desc("n"), "value")
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("field").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("field", "part").agg(F.count("*").alias("rows"))
    parts = parts.select("field", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("field", "part").orderBy(F.desc("n"), "value"))
    return ranged.join(parts, ["field", "part"]).select(
        "field", "value", "n", (F.col("before") + place - 1).alias("code")
    )


# --- naive Bayes guard -----------------------------------------------------------------------
def gram_counts(df: DataFrame, key: str, text: str = "text", hashed: bool = True) -> DataFrame:
    """(key, gram, n): trigrams of whole texts, counted inside each batch before any exchange.

    A batch sends at most one row for each of its keys and codes, however long its texts are.
    """
    ship_package(df.sparkSession)
    folded = trigrams.fold(BUCKETS) if hashed else None
    kind = df.schema[key].dataType

    def count(batches):
        names = None if hashed else pa.array(trigrams.gram_texts().tolist())
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            place = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for rows, codes in trigrams.positions(batch.column(1)):
                codes = folded[codes] if hashed else codes
                parts.append(np.unique(place[rows] * BUCKETS + codes, return_counts=True))
            if not parts:
                continue
            pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
            code = pa.array(pairs % BUCKETS)
            gram = code.cast(pa.int32()) if hashed else names.take(code)
            label = keys.dictionary.take(pa.array(pairs // BUCKETS))
            yield pa.RecordBatch.from_arrays([label, gram, pa.array(n)], names=[key, "gram", "n"])

    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("gram", T.IntegerType() if hashed else T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    )
    counted = df.select(key, F.lower(F.col(text)).alias("_text")).mapInArrow(count, schema)
    return counted.groupBy(key, "gram").agg(F.sum("n").alias("n"))


def nb_train(
    df: DataFrame, label: str, text: str = "text", alpha: float = 0.2, hashed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes as two tables.

    ``weights`` (label, gram, logp) lists seen grams; ``classes`` (label, prior, unseen) has the
    prior and the log-probability of a gram the class never saw. Counting is one partial
    aggregation, so a class holding most rows adds no hot task. The counts, one row for each class
    and gram, are written once, so the texts are read once.
    """
    counts = cut_lineage(gram_counts(df, label, text, hashed).withColumnRenamed(label, "label"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    overall = rows.agg(F.sum("rows").alias("all_rows"), F.count("*").alias("k"))
    classes = rows.join(F.broadcast(overall)).join(totals, "label", "left")
    space = F.lit(BUCKETS)
    if not hashed:  # the same for all classes, also for one without a trigram
        seen = counts.select("gram").distinct().agg(F.count("*").alias("space"))
        classes, space = classes.join(F.broadcast(seen)), F.greatest("space", F.lit(1))
    denominator = F.log(F.coalesce("total", F.lit(0)) + alpha * space)
    classes = classes.select(
        "label",
        F.log((F.col("rows") + 1.0) / (F.col("all_rows") + F.col("k"))).alias("prior"),
        (F.log(F.lit(alpha)) - denominator).alias("unseen"),
        denominator.alias("denominator"),
    )
    weights = counts.join(F.broadcast(classes), "label").select(
        "label", "gram", (F.log(F.col("n") + alpha) - F.col("denominator")).alias("logp")
    )
    return weights, classes.drop("denominator")


def nb_score(
    df: DataFrame, weights: DataFrame, classes: DataFrame, text: str = "text", hashed: bool = True
) -> DataFrame:
    """(id, label, score) of the best class; ties by the smaller label.

    Scored inside the row by a broadcast matrix (``operators/bayes.py``); more classes than that may
    have are scored by a join. A NULL or empty text gets the likeliest class and its prior.
    """
    model = bayes.bayes_model(weights, classes, BUCKETS if hashed else None)
    if model is None:
        return nb_score_by_join(df, weights, classes, text, hashed)
    best = bayes.best_class(df.sparkSession, model, text)
    return df.select("id", best.alias("best")).select("id", "best.label", "best.score")


def nb_score_by_join(
    df: DataFrame, weights: DataFrame, classes: DataFrame, text: str = "text", hashed: bool = True
) -> DataFrame:
    """``nb_score`` for any number of classes; ids must be unique.

    Weights are one map for each gram, so a gram of a text meets one row.
    """
    grams = gram_counts(df, "id", text, hashed)
    packed = (
        weights.join(F.broadcast(classes.select("label", "unseen")), "label")
        .groupBy("gram")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("label", (F.col("logp") - F.col("unseen")).alias("gain")))
            ).alias("gains")
        )
    )
    base = classes.agg(
        F.array_sort(F.collect_list(F.struct("label", "prior", "unseen"))).alias("base")
    )
    grams_of = F.coalesce(char_trigrams(F.col(text)), F.array().cast("array<string>"))
    lengths = df.select("id", F.size(grams_of).alias("length"))
    gains = (
        grams.join(packed, "gram")
        .select("id", "n", F.explode("gains").alias("label", "gain"))
        .groupBy("id", "label")
        .agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "gain"))).alias("gains"))
    )
    scored = lengths.join(gains, "id", "left").join(F.broadcast(base))
    options = F.transform(
        "base",
        lambda c: F.struct(
            (
                -(
                    c["prior"]
                    + c["unseen"] * F.col("length")
                    + F.coalesce(F.try_element_at("gains", c["label"]), F.lit(0.0))
                )
            ).alias("loss"),
            c["label"].alias("label"),
        ),
    )
    best = scored.select("id", F.array_min(options).alias("best"))
    return best.select("id", F.col("best.label").alias("label"), (-F.col("best.loss")).alias("score"))


def nb_guard(df: DataFrame, weights: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``guard_type``: the model's type, NULL where it sees no personal data."""
    model = bayes.bayes_model(weights, classes, BUCKETS)
    if model is not None:
        return df.withColumn("guard_type", bayes.guard_type(df.sparkSession, model))
    best = nb_score_by_join(df, weights, classes)
    opinion = best.select("id", F.when(F.col("label") != "NONE", F.col("label")).alias("guard_type"))
    return df.join(opinion, "id", "left")


def train_guard(df: DataFrame, label: str = "data_type", text: str = "text") -> bayes.BayesModel:
    """The type guard of ``AuditConfig.guard``, learned from labelled calls."""
    model = bayes.bayes_model(*nb_train(df, label, text), BUCKETS)
    if model is None:
        raise ValueError(f"a guard has at most {bayes.MAX_CLASSES} types")
    return model


# --- two-headed suggestion ---------------------------------------------------------------------
def softmax(scores: Column) -> Column:
    """Scores to probabilities, shifted by the maximum."""
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def top_two(probabilities: Column) -> Column:
    """Struct (best, second, at): the two largest entries and the position of the first."""
    ordered = F.sort_array(probabilities, asc=False)
    return F.struct(
        F.get(ordered, F.lit(0)).alias("best"),
        F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0)).alias("second"),
        F.array_position(probabilities, F.get(ordered, F.lit(0))).alias("at"),
    )


def joint_confidence(d: Column, v: Column) -> Column:
    """Struct (confidence, margin) of two independent heads, four decimals."""
    margin = (d["best"] - d["second"]) * v["best"] + (v["best"] - v["second"]) * d["best"]
    return F.struct(
        F.round(d["best"] * v["best"], 4).alias("confidence"), F.round(margin, 4).alias("margin")
    )


def type_head(df: DataFrame, label: str = "data_type", buckets: int = 1 << 12) -> PipelineModel:
    """Multinomial logistic regression on ``dtype_tokens``, hashed to ``buckets`` features.

    No feature is dropped by frequency and no dictionary of tokens reaches the driver.
    """
    stages = [
        StringIndexer(inputCol=label, outputCol="d_label", handleInvalid="keep"),
        HashingTF(inputCol="dtype_tokens", outputCol="d_vec", binary=True, numFeatures=buckets),
        LogisticRegression(
            featuresCol="d_vec", labelCol="d_label", probabilityCol="d_prob",
            rawPredictionCol="d_raw", predictionCol="d_pred", regParam=0.01, maxIter=15,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def encode_signals(df: DataFrame, buckets: int = 64) -> DataFrame:
    """Add one number per scalar signal and the scope indicators, for the tree model.

    A signal's value is hashed to ``buckets``, so fields of free text need no dictionary and the
    trees' bins don't depend on how many values a field has.
    """
    fields = [k for k in vocab.SIGNAL_KEYS if k != "consent_scope"]
    scope = scope_vector()
    df = df.withColumn("scope_flags", scope)
    cols = {f"s_{k}": F.pmod(F.xxhash64(signal_text(k)), F.lit(buckets)).cast("double") for k in fields}
    cols |= {f"c_{t}": F.get("scope_flags", F.lit(i)) for i, t in enumerate(vocab.PERSONAL_TYPES)}
    return df.withColumns(cols)


def violation_head(
    df: DataFrame, label: str = "violation", trees: int = 30, depth: int = 12, buckets: int = 64
) -> PipelineModel:
    """Trees over encoded signals; they express the policy's conjunctions."""
    fields = [f"s_{k}" for k in vocab.SIGNAL_KEYS if k != "consent_scope"]
    flags = [f"c_{t}" for t in vocab.PERSONAL_TYPES]
    stages = [
        StringIndexer(inputCol=label, outputCol="v_label", handleInvalid="keep"),
        VectorAssembler(inputCols=fields + flags, outputCol="v_vec"),
        RandomForestClassifier(
            featuresCol="v_vec", labelCol="v_label", probabilityCol="v_prob",
            rawPredictionCol="v_raw", predictionCol="v_pred", numTrees=trees, maxDepth=depth,
            maxBins=buckets, seed=7,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def tfidf_baseline(df: DataFrame, label: str = "combo", text: str = "text") -> PipelineModel:
    """Linear machines on TF-IDF of character 2-4-grams (column ``char_grams``)."""
    stages = [
        StringIndexer(inputCol=label, outputCol="t_label", handleInvalid="keep"),
        HashingTF(inputCol="char_grams", outputCol="t_tf", numFeatures=1 << 16),
        IDF(inputCol="t_tf", outputCol="t_vec"),
        OneVsRest(
            classifier=LinearSVC(maxIter=10), featuresCol="t_vec", labelCol="t_label",
            predictionCol="t_pred",
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside space-padded words."""
    words = F.transform(
        F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )
    def runs(n: int) -> Column:
        last = lambda w: F.greatest(F.length(w) - (n - 1), F.lit(1))
        cut = lambda w: F.transform(
            F.sequence(F.lit(1), last(w)), lambda i: F.substring(w, i, F.lit(n))
        )
        return F.flatten(F.transform(words, cut))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def combined_suggestion(df: DataFrame, types: PipelineModel, violations: PipelineModel) -> DataFrame:
    """Add ``model_combo``, ``model_confidence``, ``model_margin`` from both heads."""
    df = violations.transform(types.transform(df))
    d_labels = strings(types.stages[0].labels)
    v_labels = strings(violations.stages[0].labels)
    df = df.withColumns(
        {
            "_d": top_two(vector_to_array("d_prob")),
            "_v": top_two(vector_to_array("v_prob")),
        }
    )
    joint = joint_confidence(F.col("_d"), F.col("_v"))
    name = lambda labels, c: F.coalesce(
        F.try_element_at(labels, F.col(f"{c}.at").cast("int")), F.lit("NONE")
    )
    return df.withColumns(
        {
            "model_combo": calls.build_combo(name(d_labels, "_d"), name(v_labels, "_v")),
            "model_confidence": joint["confidence"],
            "model_margin": joint["margin"],
        }
    ).drop("_d", "_v", "d_vec", "d_raw", "d_prob", "v_vec", "v_raw", "v_prob")
