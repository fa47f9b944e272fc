"""Gradient steps next to plain numpy, and patience."""

import numpy as np
from pyspark.sql import functions as F

from textveil.operators import descent as gd


def data(spark, n=200):
    rows = [(i, "böse schlecht wort" if i % 4 == 0 else "gut schön wort", int(i % 4 == 0)) for i in range(n)]
    rows += [(n, None, 0), (n + 1, "", 1), (n + 2, "ohne", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_learns_and_stops_by_patience(spark, tmp_path):
    df = data(spark)
    model, steps = gd.fit_with_patience(df, str(tmp_path / "a"), max_steps=10, patience=2, width=64)
    rows = steps.orderBy("step").collect()
    assert rows[0].f1 == 0 and max(r.f1 for r in rows) > 0.9
    assert len(rows) <= 11 and (rows[-1].step == 10 or rows[-1].since_best == 2)
    assert all(r.best_f1 == max(x.f1 for x in rows[: i + 1]) for i, r in enumerate(rows))
    said = gd.linear_logits(model, df).select("label", (F.col("logits")[1] > 0).alias("s")).where("label = 1").agg(F.avg(F.col("s").cast("int"))).first()[0]
    assert said > 0.9


def test_one_step_is_the_plain_gradient(spark, tmp_path):
    df = data(spark, 40).where("label is not null")
    model, _ = gd.fit_with_patience(df, str(tmp_path / "b"), max_steps=1, width=16, rate=0.3)
    rows = spark.read.parquet(str(tmp_path / "b/training")).collect()
    gradient = np.zeros(17)
    train = [r for r in rows if not r.held_out]
    for r in train:
        assert not r.x or abs(sum(e.v * e.v for e in r.x) - 1) < 1e-9
        for e in r.x:
            gradient[e.i] += (0.5 - r.y) * e.v
        gradient[16] += 0.5 - r.y
    gradient /= len(train)
    state = spark.read.parquet(str(tmp_path / "b/states")).where("at = 0").first()
    want = np.where(gradient, -0.3 * np.sign(gradient), 0.0)  # the first step has the same size everywhere
    assert np.allclose(state["weights"], want, atol=1e-5)
    assert len(model.weights) == 17


def test_without_rows(spark, tmp_path):
    model, steps = gd.fit_with_patience(data(spark).limit(0), str(tmp_path / "c"), max_steps=3, patience=1, width=8)
    assert not model.weights.any() and steps.agg(F.max("f1")).first()[0] == 0
