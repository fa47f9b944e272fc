from pyspark.sql import functions as F

from textveil.operators import curate as cu
from textveil.operators import train as tr


def examples(spark):
    rows = [(i, f"ich will sterben {i % 7}", 1) for i in range(60)]
    rows += [(100 + i, f"heute esse ich pizza {i % 5}", 0) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id int, text string, label int")


def test_fit_predict_save(spark, tmp_path):
    df = examples(spark)
    model = tr.fit_safety(df)
    tr.save_model(model, str(tmp_path), "m")
    again = tr.load_model(str(tmp_path), "m")
    rows = tr.predict(again, df).collect()
    assert all(r.y_pred == r.label for r in rows)
    assert rows[0].text == "ich will sterben 0" and len(rows[0].logits) == 2


def test_selection(spark):
    model, table = tr.select_best(examples(spark), regs=(0.01, 0.1))
    assert table.count() == 2 and table.agg(F.max("f1")).first()[0] == 1.0
    checks = tr.functional_test(model, spark)
    assert checks.count() == 10 and {r.indicator for r in checks.collect()} <= {"✅ OK", "🚨 ALARM"}


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    parts = cu.split(df).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert sum(r.n for r in parts) == 500 and all(r.n == r.d for r in parts)


def test_centroids(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], None)],
        "vec_id int, embedding array<double>, label string",
    )
    rows = {r.vec_id: r for r in tr.nearest_centroid(df, tr.class_centroids(df)).collect()}
    assert [rows[i].predicted for i in (1, 2, 3)] == ["a", "a", "b"]
    assert rows[4].predicted == "a" and rows[4].cosine == -2.0


def test_whole_texts_are_read(spark):
    # what decides comes after the 128th token
    rows = [(i, "wort " * 150 + ("sterben" if i % 2 else "pizza"), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    assert all(r.y_pred == r.label for r in tr.predict(tr.fit_safety(df), df).collect())
