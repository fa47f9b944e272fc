import math
import random

import pytest
from pyspark.sql import functions as F

from textveil.operators import evaluate as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), round(rng.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, y_true int, score double")
    return df.withColumn("text", F.concat(F.lit("t"), "doc_id")), rows


def curve(rows):
    p = sum(y for _, y, _ in rows)
    n = len(rows) - p
    points = [(float("inf"), 0.0, 0.0)]
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(y for _, y, s in rows if s >= t)
        fp = sum(1 - y for _, y, s in rows if s >= t)
        points.append((t, fp / n, tp / p))
    return points


def test_roc(scored):
    df, rows = scored
    want = curve(rows)
    got = sorted(map(tuple, ev.roc_curve(df).collect()), reverse=True)
    assert len(got) == len(want)
    assert all(math.isclose(a, b, abs_tol=1e-12) for g, w in zip(got, want) for a, b in zip(g[1:], w[1:]))
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(want, want[1:]))
    assert math.isclose(ev.roc_auc(df).first()[0], area, abs_tol=1e-12)
    best = max(want, key=lambda w: (round(w[2] - w[1], 12), w[0]))
    assert ev.youden(df).first().optimal_threshold == best[0]
    summary = ev.eval_summary(df, "d", "1", "0").first()
    assert summary.optimal_threshold == best[0] and math.isclose(summary.roc_auc, area, abs_tol=1e-12)


def test_precision_recall(scored):
    df, rows = scored
    p = sum(y for _, y, _ in rows)
    ap, last = 0.0, 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(y for _, y, s in rows if s >= t)
        k = sum(1 for *_, s in rows if s >= t)
        ap, last = ap + (tp / p - last) * tp / k, tp / p
    assert math.isclose(ev.average_precision(df).first()[0], ap, abs_tol=1e-12)
    points = ev.pr_curve(df).collect()
    assert any(r.threshold is None and (r.precision, r.recall) == (1.0, 0.0) for r in points)


def test_histogram_sums_and_edges(scored, spark):
    df, rows = scored
    bins = ev.score_histogram(df, 30).collect()
    assert sum(r.n for r in bins) == 400 and all(0 <= r.bin < 30 for r in bins)
    flat = spark.createDataFrame([(0, 0.5), (0, 0.5)], "y_true int, score double")
    assert [tuple(r) for r in ev.score_histogram(flat, 30).collect()] == [(0, 15, 2)]


def test_confusion_and_metrics(scored):
    df, rows = scored
    pred = ev.predict_at(df, 0.5)
    cells = {(r.y_true, r.y_pred): r.n for r in ev.confusion(pred).collect()}
    assert sum(cells.values()) == 400
    tp, fp, fn = cells[1, 1], cells[0, 1], cells[1, 0]
    m = ev.binary_metrics(pred).first()
    assert math.isclose(m.precision, tp / (tp + fp)) and math.isclose(m.recall, tp / (tp + fn))
    assert math.isclose(m.f1, 2 * tp / (2 * tp + fp + fn))


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "y_true int, y_pred int")
    assert tuple(ev.binary_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)
    report = {r["class"]: r for r in ev.class_report(df).collect()}
    assert report["1"].f1 == 0.0 and report["accuracy"].f1 == 1.0


def test_errors(scored):
    df, rows = scored
    fp = ev.false_positives(df, 0.5, 3).collect()
    want = sorted(((-s, i) for i, y, s in rows if y == 0 and s >= 0.5))[:3]
    assert [(-r.score, r.doc_id) for r in fp] == want and fp[0].category == "N/A"


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0)], "id int, y_true int, y_pred int")
    b = a.withColumn("y_pred", F.col("y_true"))
    rows = {r.metric: r for r in ev.compare_models(a, b).collect()}
    assert math.isclose(rows["recall"].delta, 0.5)
    assert math.isclose(ev.agreement(a, b).first()[0], 200 / 3)
