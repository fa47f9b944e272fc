"""Queries: curves, reports and errors of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.scores import argmax
from textveil.operators import evaluate as ev
from textveil.plans import corpus as co
from textveil.plans.registry import query, table


def r6(name):
    return F.round(name, 6).alias(name)


WITH_COUNTS = f"WITH {co.SCORED_EVENTS}, {co.COUNTS}"


@query("e1_truth", "SELECT doc_id, (toxic = 1)::INTEGER AS y_true FROM labels")
def e1(spark, sf):
    return table(spark, sf, "labels").select("doc_id", ev.y_true("toxic", "1").alias("y_true"))


@query(
    "e2_roc_curve",
    f"{WITH_COUNTS} SELECT threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE",
)
def e2(spark, sf):
    curve = ev.roc_curve(co.scored_events(spark, sf))
    threshold = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return curve.select(threshold.alias("threshold"), r6("fpr"), r6("tpr"))


@query("e3_roc_auc", f"{WITH_COUNTS} SELECT round(sum(neg * (2 * tp - pos)) / 2.0 / (sum(pos) * sum(neg)), 6)::DOUBLE AS roc_auc FROM c")
def e3(spark, sf):
    return ev.roc_auc(co.scored_events(spark, sf)).select(r6("roc_auc"))


@query(
    "e4_optimal_threshold",
    f"{WITH_COUNTS} SELECT threshold AS optimal_threshold, round(tp / p - fp / n, 6) AS j FROM c ORDER BY round(tp / p - fp / n, 12) DESC, threshold DESC LIMIT 1",
)
def e4(spark, sf):
    return ev.youden(co.scored_events(spark, sf)).select("optimal_threshold", r6("j"))


@query(
    "e5_precision_recall_curve",
    f"""{WITH_COUNTS} SELECT threshold, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / p, 6)::DOUBLE AS recall FROM c
    UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
)
def e5(spark, sf):
    return ev.pr_curve(co.scored_events(spark, sf)).select("threshold", r6("precision"), r6("recall"))


@query("e6_average_precision", f"{WITH_COUNTS} SELECT round(sum(pos * (tp / (tp + fp))) / sum(pos), 6)::DOUBLE AS average_precision FROM c")
def e6(spark, sf):
    return ev.average_precision(co.scored_events(spark, sf)).select(r6("average_precision"))


@query("e7_prevalence", f"WITH {co.SCORED_EVENTS} SELECT round(avg(y_true), 6) AS prevalence FROM scored")
def e7(spark, sf):
    return ev.prevalence(co.scored_events(spark, sf)).select(r6("prevalence"))


def _histogram(keys: str) -> str:
    over = f"OVER ({keys})"
    return f"""WITH {co.SCORED_EVENTS}, h AS (SELECT y_true, score, min(score) {over} AS lo, max(score) {over} AS hi FROM scored)
    SELECT y_true, least(floor((score - lo) / (hi - lo) * 30), 29)::INTEGER AS bin, count(*) AS n FROM h GROUP BY 1, 2"""


@query("e8_score_histogram", _histogram("PARTITION BY y_true"))
def e8(spark, sf):
    return ev.score_histogram(co.scored_events(spark, sf))


@query("e8_shared_histogram", _histogram(""))
def e8_shared(spark, sf):
    return ev.score_histogram(co.scored_events(spark, sf), shared_range=True)


@query("e9_predictions", f"WITH {co.SCORED_DOCS} SELECT doc_id, (score >= 0.5)::INTEGER AS y_pred FROM scored")
def e9(spark, sf):
    return ev.predict_at(co.scored_docs(spark, sf), 0.5).select("doc_id", "y_pred")


@query(
    "e10_confusion_matrix",
    f"""WITH {co.SCORED_EVENTS}, g(y_true, y_pred) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
    k AS (SELECT y_true, (score >= 5)::INTEGER AS y_pred, count(*) AS n FROM scored GROUP BY 1, 2)
    SELECT g.y_true, g.y_pred, coalesce(n, 0) AS n FROM g LEFT JOIN k ON k.y_true = g.y_true AND k.y_pred = g.y_pred""",
)
def e10(spark, sf):
    return ev.confusion(ev.predict_at(co.scored_events(spark, sf), 5))


_PRED = "pr AS (SELECT *, (score >= 0.5)::INTEGER AS y_pred FROM scored)"


@query(
    "e11_class_report",
    f"""WITH {co.SCORED_DOCS}, {_PRED}, k(c, name) AS (VALUES (0, 'SAFE'), (1, 'UNSAFE')),
    m AS (SELECT c, name, count(*) FILTER (y_true = c AND y_pred = c)::DOUBLE AS hit, count(*) FILTER (y_true = c) AS sup,
          count(*) FILTER (y_pred = c) AS picked FROM pr CROSS JOIN k GROUP BY 1, 2),
    f AS (SELECT *, coalesce(hit / nullif(picked, 0), 0) AS p, coalesce(hit / nullif(sup, 0), 0) AS r FROM m),
    q AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM f)
    SELECT name AS class, round(p, 3) AS precision, round(r, 3) AS recall, round(f1, 3) AS f1, sup AS support FROM q
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(sup), 3), sum(sup)::BIGINT FROM q
    UNION ALL SELECT 'macro avg', round(avg(p), 3), round(avg(r), 3), round(avg(f1), 3), sum(sup)::BIGINT FROM q
    UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 3), round(sum(r * sup) / sum(sup), 3), round(sum(f1 * sup) / sum(sup), 3), sum(sup)::BIGINT FROM q""",
)
def e11(spark, sf):
    return ev.class_report(ev.predict_at(co.scored_docs(spark, sf), 0.5), names=("SAFE", "UNSAFE"))


def _errors_sql(truth: int, op: str, order: str) -> str:
    return f"""WITH {co.SCORED_DOCS} SELECT doc_id, score, category,
      CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview
    FROM scored WHERE y_true = {truth} AND score {op} 0.5 ORDER BY score {order}, doc_id LIMIT 5"""


@query("e12_false_positives", _errors_sql(0, ">=", "DESC"))
def e12(spark, sf):
    return ev.false_positives(co.scored_docs(spark, sf), 0.5)


@query("e13_false_negatives", _errors_sql(1, "<", "ASC"))
def e13(spark, sf):
    return ev.false_negatives(co.scored_docs(spark, sf), 0.5)


@query(
    "e14_summary",
    f"""{WITH_COUNTS} SELECT 'events' AS dataset, 'is an error' AS hypothesis, 'error' AS positive_label, 'other' AS negative_label,
      round(sum(neg * (2 * tp - pos)) / 2.0 / (sum(pos) * sum(neg)), 6)::DOUBLE AS roc_auc,
      round(sum(pos * (tp / (tp + fp))) / sum(pos), 6)::DOUBLE AS average_precision,
      first(threshold ORDER BY round(tp / p - fp / n, 12) DESC, threshold DESC) AS optimal_threshold FROM c""",
)
def e14(spark, sf):
    one = ev.eval_summary(co.scored_events(spark, sf), "events", "error", "other", "is an error")
    return one.withColumn("roc_auc", F.round("roc_auc", 6)).withColumn("average_precision", F.round("average_precision", 6))


def _binary(pred: str, prefix: str = "") -> str:
    return f"""coalesce(avg((y_true = {pred})::INTEGER), 0) AS {prefix}accuracy,
      coalesce(count(*) FILTER (y_true = 1 AND {pred} = 1)::DOUBLE / nullif(count(*) FILTER ({pred} = 1), 0), 0) AS {prefix}precision,
      coalesce(count(*) FILTER (y_true = 1 AND {pred} = 1)::DOUBLE / nullif(count(*) FILTER (y_true = 1), 0), 0) AS {prefix}recall,
      coalesce(2 * count(*) FILTER (y_true = 1 AND {pred} = 1)::DOUBLE / nullif(count(*) FILTER (y_true = 1) + count(*) FILTER ({pred} = 1), 0), 0) AS {prefix}f1"""


@query(
    "e15_binary_metrics",
    f"""WITH {co.SCORED_DOCS}, {_PRED}, m AS (SELECT {_binary('y_pred')} FROM pr)
    SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m""",
)
def e15(spark, sf):
    one = ev.binary_metrics(ev.predict_at(co.scored_docs(spark, sf), 0.5))
    return one.select(*[r6(m) for m in ev.METRICS])


@query(
    "e16_argmax",
    f"""WITH {co.sql_long(['a', 'b', 'c', 'd'])} SELECT doc_id, first(j ORDER BY x DESC, j)::INTEGER AS prediction FROM long GROUP BY 1""",
)
def e16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", argmax(co.logits(4)).alias("prediction"))


_BOTH = "b AS (SELECT *, (score >= 0.5)::INTEGER AS pa, ((score * 1000)::BIGINT % 3 = 0)::INTEGER AS pb FROM scored)"


def _two_models(spark, sf):
    docs = co.scored_docs(spark, sf).withColumnRenamed("doc_id", "id")
    other = docs.withColumn("y_pred", (F.round(F.col("score") * 1000).cast("bigint") % 3 == 0).cast("int"))
    return ev.predict_at(docs, 0.5), other


@query(
    "e17_model_comparison",
    f"""WITH {co.SCORED_DOCS}, {_BOTH}, m AS (SELECT {_binary('pa', 'a_')}, {_binary('pb', 'b_')} FROM b)
    """
    + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, round(a_{k}, 6) AS original, round(b_{k}, 6) AS other, round(b_{k} - a_{k}, 6) AS delta FROM m"
        for k in ev.METRICS
    ),
)
def e17(spark, sf):
    table_ = ev.compare_models(*_two_models(spark, sf))
    return table_.select("metric", r6("original"), r6("other"), r6("delta"))


@query("e18_agreement", f"WITH {co.SCORED_DOCS}, {_BOTH} SELECT round(avg((pa = pb)::INTEGER) * 100, 6) AS agreement_pct FROM b")
def e18(spark, sf):
    return ev.agreement(*_two_models(spark, sf)).select(r6("agreement_pct"))
