import math

import pytest
from pyspark.sql import functions as F

from textveil.constants import LABELS_EN
from textveil.functions.scores import argmax, score_band, softmax
from textveil.operators import classify as cl


def fake_scorer():
    return lambda texts, hyps: [[float(len(t) % (i + 2)) for i in range(len(h))] for t, h in zip(texts, hyps)]


def test_scores_modes_and_blank(frame):
    df = cl.score(frame("hallo welt", " \n"), fake_scorer, LABELS_EN)
    single = cl.classify(df, LABELS_EN, multi_label=False).orderBy("doc_id").collect()
    assert math.isclose(sum(e.score for e in single[0].result), 1.0)
    assert [e.score for e in single[0].result] == sorted((e.score for e in single[0].result), reverse=True)
    assert [(e.label, e.score) for e in single[1].result] == [(label, 0.0) for label in LABELS_EN]
    multi = cl.classify(df, LABELS_EN, mapping={"suicide": "S"}).orderBy("doc_id").collect()
    logits = df.orderBy("doc_id").first().logits
    want = {label: 1 / (1 + math.exp(-x)) for label, x in zip(LABELS_EN, logits)}
    for e in multi[0].result:
        assert math.isclose(e.score, want[e.label])
        assert e.display_label == ("S" if e.label == "suicide" else e.label)


def test_blank_never_reaches_the_scorer(frame):
    def load():
        def scorer(texts, hyps):
            assert all(t.strip() for t in texts)
            return [[1.0]] * len(texts)

        return scorer

    rows = cl.score(frame("a", "", None, " "), load, ["x"]).orderBy("doc_id").collect()
    assert [r.logits for r in rows] == [[1.0], None, None, None]


@pytest.mark.parametrize(
    "logits,label", [([1.0, 2.0], "UNSAFE"), ([2.0, 1.0], "SAFE"), ([1.0, 1.0], "SAFE")]
)
def test_binary_label(spark, logits, label):
    df = spark.createDataFrame([(logits,)], "x array<double>")
    assert df.select(cl.binary_label("x")["label"]).first()[0] == label


def test_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 999.0],)], "x array<double>")
    p = df.select(softmax("x")).first()[0]
    assert math.isclose(p[0], 1 / (1 + math.exp(-1)))
    assert df.select(argmax("x")).first()[0] == 0


def test_bands(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.69,), (0.7,)], "s double")
    assert [r[0] for r in df.select(score_band("s")).collect()] == ["low", "medium", "medium", "high"]


def test_empty_result(spark):
    df = spark.createDataFrame([([],)], "r array<struct<label:string,display_label:string,score:double>>")
    assert tuple(df.select(cl.top_label("r"), cl.top_score("r")).first()) == ("", 0.0)


def test_contrast_falls_back_to_first(frame):
    df = cl.score(frame("hallo"), fake_scorer, ["a", "b"])
    r = cl.classify(df, ["a", "b"], multi_label=False)
    top = r.select(cl.top_score("result")).first()[0]
    assert r.select(cl.contrast_score("result", "zzz")).first()[0] == top


def test_relevance(spark):
    rows = [("F", "gut", [2.0, 1.0]), ("F", "schlecht", [0.0, 1.0]), ("F", "gleich", [1.0, 1.0]), ("F", " ", [5.0, 0.0])]
    df = spark.createDataFrame(rows, "question string, answer string, logits array<double>")
    got = [(r.is_relevant, r.verdict) for r in cl.relevance(df).collect()]
    assert got == [(True, "relevant"), (False, "off-topic"), (True, "relevant"), (False, "off-topic")]
    last = cl.relevance(df).collect()[3]
    assert (last.relevance_score, last.irrelevance_score) == (0.0, 1.0)


def test_qa_text_keeps_braces(spark):
    df = spark.createDataFrame([("{answer}?", "ja")], "question string, answer string")
    assert df.select(cl.qa_text("question", "answer")).first()[0] == "Frage: {answer}? Antwort: ja"


def test_edit_labels(spark):
    got = spark.range(1).select(cl.edit_labels(["a", "b"], add=[" c ", "a", " "], remove=["b"])).first()[0]
    assert got == ["a", "c"]


def test_alerts_use_raw_labels(spark):
    ddl = "r array<struct<label:string,display_label:string,score:double>>"
    df = spark.createDataFrame([([("suicide", "x", 0.6), ("violence", "y", 0.5), ("safe", "suicide", 0.9)],)], ddl)
    assert [e.label for e in df.select(cl.content_alert("r")).first()[0]] == ["suicide"]


def test_confidence_fallback(spark):
    df = spark.createDataFrame([(1, None), (0, [0.7, 0.3])], "label_id int, probs array<double>")
    rows = cl.with_confidence(df).select("label", "confidence").collect()
    assert [tuple(r) for r in rows] == [("UNSAFE", 1.0), ("SAFE", 0.7)]


def test_record(frame):
    df = cl.to_result(cl.classify(cl.score(frame("abc"), fake_scorer, ["a"]), ["a"]))
    back = df.select(F.from_json("record", "labels array<string>, top_label string, multi_label boolean").alias("r")).first().r
    assert (back.labels, back.top_label, back.multi_label) == (["a"], "a", True)
