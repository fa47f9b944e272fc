"""Training in distributed gradient steps, with held-out F1 after each and patience.

Texts become hashed word weights once, in a stored table.  A step is one job: every
task adds up the gradient of its training rows and the hits of its held-out rows for
the weights so far, which are broadcast and have a fixed size.  The best step by F1
is kept, and training ends after some steps without a better one.  Each step's state
is a table, so a job that was stopped goes on from the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textveil.constants import SEED, TEST_FRACTION
from textveil.functions.text import as_col
from textveil.operators.bayes import bayes_tokens
from textveil.operators.curate import split

WIDTH = 1 << 15
RATE = 0.5
STEPS = "step int, loss double, accuracy double, precision double, recall double, f1 double, best_step int, best_f1 double, since_best int"
STATE = f"weights array<double>, squares array<double>, best array<double>, {STEPS}"


@dataclass(frozen=True)
class LinearModel:
    """Weights of hashed words; the last one is the constant."""

    weights: np.ndarray

    def save(self, spark: SparkSession, path: str) -> str:
        row = spark.createDataFrame([(json.dumps(self.weights.tolist()),)], "weights string")
        row.coalesce(1).write.mode("overwrite").json(path)
        return path


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    row = spark.read.schema("weights string").json(path).first()
    return LinearModel(np.array(json.loads(row["weights"])))


def hashed_words(txt, width: int = WIDTH) -> Column:
    """``(i, v)`` of a text: the hashed words in order, and their weights, of length 1 together."""
    places = F.transform(bayes_tokens(txt), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))

    def weigh(lists: pa.Array) -> pa.Array:
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        flat, row = flat[offsets[0] : offsets[-1]], np.repeat(np.arange(len(lists)), np.diff(offsets))
        code, n = np.unique(row * width + flat, return_counts=True)
        row, place = np.divmod(code, width)
        v = 1.0 + np.log(n)
        v /= np.sqrt(np.bincount(row, v * v, minlength=len(lists)))[row] if len(row) else 1.0
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lists)))))
        values = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(v)], ["i", "v"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return F.arrow_udf(weigh, "array<struct<i:int,v:double>>")(places)


def _sparse(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of all entries of a batch."""
    offsets, values = x.offsets.to_numpy(), x.values.slice(x.offsets[0].as_py(), x.offsets[len(x)].as_py() - x.offsets[0].as_py())
    return np.repeat(np.arange(len(x)), np.diff(offsets)), values.field("i").to_numpy(), values.field("v").to_numpy()


def _margins(x: pa.Array, weights: np.ndarray) -> np.ndarray:
    row, i, v = _sparse(x)
    return np.bincount(row, v * weights[i], minlength=len(x)) + weights[-1]


def _step_sums(sent):
    """What a task's rows add: the gradient (i from 0), the loss (-1), and held-out tp, fp, fn, tn (-2 to -5)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        gradient, more = np.zeros(len(weights)), np.zeros(5)
        for batch in batches:
            x, y = batch.column("x"), batch.column("y").to_numpy().astype(float)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            z = _margins(x, weights)
            off = np.where(held, 0.0, 1 / (1 + np.exp(-z)) - y)
            row, i, v = _sparse(x)
            gradient += np.bincount(i, off[row] * v, minlength=len(weights))
            gradient[-1] += off.sum()
            more[0] += np.logaddexp(0, np.where(y > 0, -z, z))[~held].sum()
            said, true = z[held] > 0, y[held] > 0
            more[1:] += [(said & true).sum(), (said & ~true).sum(), (~said & true).sum(), (~said & ~true).sum()]
        at = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, -1 - np.arange(5)))), pa.array(np.concatenate((gradient[at], more)))], ["i", "v"])

    return run


def training_table(df: DataFrame, path: str, txt: str = "text", label: str = "label", key: str = "doc_id", fraction: float = TEST_FRACTION, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """``(y, held_out, x)`` of the rows with a label, written to ``path``."""
    sides = split(df.where(F.col(label).isNotNull()), fraction, seed, key)
    rows = sides.select(F.col(label).cast("int").alias("y"), (F.col("split") == "test").alias("held_out"), hashed_words(F.coalesce(txt, F.lit("")), width).alias("x"))
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _last_state(spark: SparkSession, path: str):
    """The newest whole state below ``path``, or None."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(f"at int, {STATE}").parquet(path)
        return found.orderBy(F.desc("at")).limit(1).collect()[0]
    except (AnalysisException, IndexError):
        return None


def fit_with_patience(df: DataFrame, root: str, txt: str = "text", label: str = "label", key: str = "doc_id", max_steps: int = 10, patience: int = 3, rate: float = RATE, width: int = WIDTH, resume: bool = False, **sides) -> tuple[LinearModel, DataFrame]:
    """The best model by held-out F1, and the table of steps.

    Step 0 is the model without any learning.  Training ends at ``max_steps`` or after
    ``patience`` steps without a higher F1.  With ``resume`` it goes on from the last
    step that is saved below ``root``, with the same rows.  Without training rows the
    weights stay 0; without held-out positives F1 is 0.
    """
    spark = df.sparkSession
    table, states = f"{root}/training", f"{root}/states"
    last = _last_state(spark, states) if resume else None
    if last is None:
        rows = training_table(df, table, txt, label, key, width=width, **sides)
        weights, squares = np.zeros(width + 1), np.zeros(width + 1)
        best, at, best_at = weights.copy(), -1, (-1, -1.0)
        history: list[tuple] = []
    else:
        rows = spark.read.parquet(table)
        weights, squares, best, at = (np.array(last[c]) for c in ("weights", "squares", "best", "at"))
        at, best_at = int(at), (last["best_step"], last["best_f1"])
        history = [tuple(r) for r in spark.read.schema(f"at int, {STEPS}").parquet(states).where(F.col("at") <= at).drop("at").orderBy("step").collect()]
    n = rows.where("not held_out").count()
    while at < max_steps and (not history or history[-1][-1] < patience):
        at += 1
        sent = spark.sparkContext.broadcast(weights)
        sums = rows.mapInArrow(_step_sums(sent), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        sent.unpersist()
        value = dict(zip(sums["i"].tolist(), sums["v"].tolist()))
        loss, tp, fp, fn, tn = (value.pop(-1 - k, 0.0) for k in range(5))
        precision, recall = tp / max(tp + fp, 1.0), tp / max(tp + fn, 1.0)
        f1 = 2 * tp / max(2 * tp + fp + fn, 1.0)
        if f1 > best_at[1]:
            best, best_at = weights.copy(), (at, f1)
        history.append((at, loss / max(n, 1), (tp + tn) / max(tp + fp + fn + tn, 1.0), precision, recall, f1, *best_at, at - best_at[0]))
        gradient = np.zeros(width + 1)
        gradient[list(value)] = list(value.values())
        gradient /= max(n, 1)
        squares = squares + gradient * gradient
        weights = weights - rate * gradient / (np.sqrt(squares) + 1e-9)
        state = spark.createDataFrame([(weights.tolist(), squares.tolist(), best.tolist(), *history[-1])], STATE)
        state.coalesce(1).write.mode("overwrite").parquet(f"{states}/at={at}")
    return LinearModel(best), spark.createDataFrame(history, STEPS)


def linear_logits(model: LinearModel, df: DataFrame, txt: str = "text", out: str = "logits") -> DataFrame:
    """Add the logits of both classes; a null text has no words."""
    sent = df.sparkSession.sparkContext.broadcast(model.weights)

    def run(x: pa.Array) -> pa.Array:
        z = _margins(x, sent.value)
        return pa.array([[-a / 2, a / 2] for a in z.tolist()], pa.list_(pa.float64()))

    scored = df.withColumn("_x", hashed_words(F.coalesce(as_col(txt), F.lit("")), len(model.weights) - 1))
    return scored.withColumn(out, F.arrow_udf(run, "array<double>")("_x")).drop("_x")
