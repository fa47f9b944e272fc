"""Distributed text classifiers: features, fitting, selection, vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textveil.constants import (
    FUNCTIONAL_EXAMPLES,
    INDICATORS,
    SAFETY_LABELS,
    SEED,
    TEST_FRACTION,
)
from textveil.functions.scores import argmax, cosine
from textveil.functions.text import truncate_tokens
from textveil.operators.curate import split
from textveil.operators.evaluate import binary_metrics

FEATURES = 1 << 15
MAX_CLASSES = 1000


def text_features(txt: str = "text", n_features: int = FEATURES) -> list:
    """Stages that turn the whole text into weighted token counts."""
    return [
        RegexTokenizer(inputCol=txt, outputCol="_tokens", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def readable(df: DataFrame, txt: str = "text", max_tokens: int | None = None) -> DataFrame:
    """The text as the features read it: whole, or its first ``max_tokens`` if asked for."""
    return df.withColumn(txt, F.coalesce(txt if max_tokens is None else truncate_tokens(txt, max_tokens), F.lit("")))


def fit_safety(df: DataFrame, txt: str = "text", label: str = "label", reg: float = 0.01, max_iter: int = 20, max_tokens: int | None = None) -> PipelineModel:
    """Fit a SAFE (0) / UNSAFE (1) classifier on whole texts; rows without a label are left out."""
    train = readable(df.where(F.col(label).isNotNull()).select(txt, F.col(label).cast("double").alias(label)), txt, max_tokens)
    head = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[*text_features(txt), head]).fit(train)


def predict(model: PipelineModel, df: DataFrame, txt: str = "text", out: str = "y_pred", max_tokens: int | None = None) -> DataFrame:
    """Add ``logits``, ``probs`` and the predicted class to the input columns."""
    kept = df.withColumn("_original", F.col(txt))
    scored = model.transform(readable(kept, txt, max_tokens))
    return scored.select(
        *[F.col("_original").alias(c) if c == txt else F.col(c) for c in df.columns],
        vector_to_array("rawPrediction").alias("logits"),
        vector_to_array("probability").alias("probs"),
        F.col("prediction").cast("int").alias(out),
    )


def select_best(df: DataFrame, regs: Sequence[float] = (0.001, 0.01, 0.1), txt: str = "text", label: str = "label", key: str = "doc_id", fraction: float = TEST_FRACTION, seed: int = SEED, max_tokens: int | None = None):
    """Fit one candidate per penalty and keep the best F1 on held-out rows.

    Returns the model and a table of ``(reg, accuracy, precision, recall, f1)``.
    Features do not depend on the penalty, so they are fitted once.
    """
    sides = split(readable(df.where(F.col(label).isNotNull()), txt, max_tokens), fraction, seed, key).withColumn(label, F.col(label).cast("double"))
    train, test = sides.where("split = 'train'"), sides.where("split = 'test'")
    base = Pipeline(stages=text_features(txt)).fit(train)
    fit_on, eval_on = base.transform(train).select(label, "features").cache(), base.transform(test).cache()
    best, rows = None, []
    for reg in regs:
        head = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=20).fit(fit_on)
        scored = head.transform(eval_on).select(
            F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")
        )
        m = binary_metrics(scored).first()
        rows.append((float(reg), *map(float, m)))
        if best is None or m["f1"] > best[0]:
            best = (m["f1"], PipelineModel(stages=[*base.stages, head]))
    fit_on.unpersist()
    eval_on.unpersist()
    table = df.sparkSession.createDataFrame(
        rows, "reg double, accuracy double, precision double, recall double, f1 double"
    )
    return best[1], table


def save_model(model: PipelineModel, root: str, model_id: str) -> str:
    path = f"{root}/{model_id}/best_model"
    model.write().overwrite().save(path)
    return path


def load_model(root: str, model_id: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/{model_id}/best_model")


def functional_examples(spark: SparkSession) -> DataFrame:
    rows = [(i, t, e) for i, (t, e) in enumerate(FUNCTIONAL_EXAMPLES)]
    return spark.createDataFrame(rows, "example_id int, text string, expected string")


def functional_test(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Predictions for the functional examples, with an indicator."""
    scored = predict(model, functional_examples(spark))
    label = F.when(F.col("y_pred") == 1, SAFETY_LABELS[1]).otherwise(SAFETY_LABELS[0])
    return scored.withColumn("predicted", label).select(
        "example_id",
        "text",
        "expected",
        "predicted",
        F.when(F.col("predicted") == SAFETY_LABELS[1], INDICATORS["UNSAFE"]).otherwise(INDICATORS["SAFE"]).alias("indicator"),
        (F.col("expected") == F.col("predicted")).alias("ok"),
    )


# --- classifiers on sentence vectors ----------------------------------------

def class_centroids(vectors: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per class, combined in the map tasks."""
    ready = vectors.where(F.col(label).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return ready.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def pair_scatter(vectors: DataFrame, pairs: DataFrame, vec: str = "embedding", key: str = "doc_id") -> DataFrame:
    """``(same, i, j, total)``: summed products of the differences of paired vectors.

    ``pairs`` has ``left_id``, ``right_id`` and ``same`` (1 within a class, 0 between
    classes).  Each task adds up its pairs to one matrix of each kind, so what is
    shuffled does not grow with the pairs.  Pairs with a null vector are left out.
    """
    side = lambda name, out: vectors.select(F.col(key).alias(name), F.col(vec).cast("array<double>").alias(out))
    both = pairs.select("left_id", "right_id", "same").join(side("left_id", "x"), "left_id").join(side("right_id", "y"), "right_id")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            same = batch.column("same").to_numpy()
            x, y = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1)) for c in "xy")
            for k in np.unique(same).tolist():
                d = (x - y)[same == k]
                sums[k] = sums.get(k, 0.0) + d.T @ d
        for k, m in sums.items():
            i, j = np.indices(m.shape)
            cols = [np.full(m.size, k, np.int32), i.ravel().astype(np.int32), j.ravel().astype(np.int32), m.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["same", "i", "j", "total"])

    parts = both.where("x is not null and y is not null").select("same", "x", "y").mapInArrow(products, "same int, i int, j int, total double")
    return parts.groupBy("same", "i", "j").agg(F.sum("total").alias("total"))


def whitening(scatter: DataFrame, ridge: float = 0.1) -> np.ndarray:
    """The projection after which pairs within classes differ alike in all directions, and pairs between classes most.

    Directions in which a class spreads are shortened, those in which classes differ
    stay.  The matrices have the square of the vectors' width, whatever the rows.
    """
    rows = scatter.toPandas()
    width = int(rows["i"].max()) + 1
    within, between = (np.zeros((width, width)) for _ in range(2))
    for same, m in ((1, within), (0, between)):
        part = rows[rows["same"] == same]
        m[part["i"], part["j"]] = part["total"]
    within /= max(np.trace(within) / width, 1e-12)
    values, vectors = np.linalg.eigh(within + ridge * np.eye(width))
    white = vectors @ np.diag(values**-0.5) @ vectors.T
    spread = white @ between @ white.T
    values, vectors = np.linalg.eigh(spread / max(np.trace(spread) / width, 1e-12))
    return np.diag(np.sqrt(np.maximum(values, 0.0))) @ vectors.T @ white


def projected(vec, matrix: np.ndarray) -> Column:
    """The vector times a matrix."""
    held = np.asarray(matrix, float)

    def run(vectors: pa.Array) -> pa.Array:
        rows = [None if v is None else held @ v.astype(float) for v in vectors.to_numpy(zero_copy_only=False)]
        return pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(F.col(vec) if isinstance(vec, str) else vec)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vec: str = "embedding", label: str = "label", out: str = "predicted") -> DataFrame:
    """Add the class with the largest cosine and that cosine.

    The centroids are collected after a check of their number and become a
    literal of the plan; a tie goes to the first class.
    """
    rows = centroids.select(label, "centroid").orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    kind = dict(centroids.dtypes)[label]
    values = json.dumps([{"label": r[label], "c": list(r["centroid"])} for r in rows])
    table = F.from_json(F.lit(values), f"array<struct<label:{kind},c:array<double>>>")
    scores = F.transform(table, lambda t: F.coalesce(cosine(vec, t["c"]), F.lit(-2.0)))
    scored = vectors.withColumn("_scores", scores)
    return (
        scored.withColumn(out, F.get(table, argmax("_scores"))["label"])
        .withColumn("cosine", F.array_max("_scores"))
        .drop("_scores")
    )


def fit_head(vectors: DataFrame, vec: str = "embedding", label: str = "label", reg: float = 0.0):
    """Logistic regression on vectors."""
    ready = vectors.where(F.col(label).isNotNull()).select(
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias(label)
    )
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=50).fit(ready)
