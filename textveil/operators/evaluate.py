"""Scoring classifiers against the truth: curves, reports and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textveil.functions.scores import safe_ratio
from textveil.functions.text import preview
from textveil.operators.ranking import running_totals

BINS = 30


def y_true(label, positive) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return (label.cast("string") == F.lit(str(positive))).cast("int")


def score_counts(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Positives and negatives per distinct score; ties of any size are one row."""
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(truth)).cast("bigint").alias("pos"),
        F.sum(1 - F.col(truth)).cast("bigint").alias("neg"),
    )


def threshold_counts(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Per distinct score, highest first: cumulative true and false positives."""
    cum = running_totals(score_counts(df, score, truth), "threshold", ["pos", "neg"])
    return cum.select("threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


def _totals(df: DataFrame, score: str, truth: str) -> tuple[Column, Column]:
    """All positives and negatives, from the same counts the curve is built on."""
    one = score_counts(df, score, truth).agg(
        F.struct(
            F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n")
        ).alias("t")
    ).scalar()
    return one["p"], one["n"]


def roc_curve(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score and the origin.

    The origin's threshold is infinite: nothing is predicted positive.
    """
    p, n = _totals(df, score, truth)
    points = threshold_counts(df, score, truth).select(
        "threshold",
        F.try_divide(F.col("fp").cast("double"), n).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), p).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return points.unionByName(origin)


def roc_auc(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Area under the ROC curve by trapezoids, one row.

    A step of the curve at one score spans ``neg`` in width and runs from
    ``tp - pos`` to ``tp`` in height, so no neighbour lookup is needed.
    """
    counts = threshold_counts(df, score, truth)
    return counts.agg(_area().alias("roc_auc"))


def _area() -> Column:
    neg, pos, tp = (F.col(c).cast("double") for c in ("neg", "pos", "tp"))
    return F.try_divide(F.sum(neg * (2 * tp - pos)) / 2, F.sum(pos) * F.sum(neg))


def youden(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on a tie."""
    curve = roc_curve(df, score, truth).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return curve.agg(F.max(F.struct("j", "threshold", "fpr", "tpr")).alias("best")).select(
        F.col("best.threshold").alias("optimal_threshold"), "best.fpr", "best.tpr", "best.j"
    )


def pr_curve(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score and the end point (1, 0)."""
    p, _ = _totals(df, score, truth)
    points = threshold_counts(df, score, truth).select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), p), F.lit(1.0)).alias("recall"),
    )
    end = df.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return points.unionByName(end)


def average_precision(df: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Sum of recall steps weighted by precision, one row."""
    counts = threshold_counts(df, score, truth)
    pos, tp, fp = (F.col(c).cast("double") for c in ("pos", "tp", "fp"))
    weighted = F.sum(pos * tp / (tp + fp))
    return counts.agg(safe_ratio(weighted, F.sum("pos")).alias("average_precision"))


def prevalence(df: DataFrame, truth: str = "y_true") -> DataFrame:
    return df.agg(F.avg(F.col(truth).cast("double")).alias("prevalence"))


def score_histogram(df: DataFrame, bins: int = BINS, score: str = "score", truth: str = "y_true", shared_range: bool = False) -> DataFrame:
    """``(y_true, bin, n)`` over equal-width bins of each class's own range.

    With ``shared_range`` both classes use the range of all scores.  The last
    bin includes its upper edge; a range of one value is widened by 0.5 on
    either side.
    """
    counts = df.groupBy(F.col(truth).alias("y_true"), F.col(score).alias("s")).agg(F.count("*").alias("c"))
    # two classes: their edges are one row, not a join on a two-valued key
    own = [F.lit(True)] * 2 if shared_range else [F.col("y_true") == k for k in (0, 1)]
    edges = counts.agg(
        F.struct(
            *[f(F.when(own[k], F.col("s"))).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in (0, 1)]
        ).alias("e")
    ).scalar()
    pick = [F.when(F.col("y_true") == 0, edges[f"{n}0"]).otherwise(edges[f"{n}1"]) for n in ("lo", "hi")]
    wide = counts.withColumn("_lo", pick[0]).withColumn("_hi", pick[1])
    flat = F.col("_lo") == F.col("_hi")
    ready = wide.withColumn("lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn(
        "hi", F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    )
    place = F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (
        ready.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy("y_true", "bin")
        .agg(F.sum("c").alias("n"))
    )


def predict_at(df: DataFrame, threshold, score: str = "score", out: str = "y_pred") -> DataFrame:
    """Add the 0/1 prediction ``score >= threshold``."""
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All four cells of the 2x2 matrix, also the empty ones."""
    one = df.agg(
        *[
            F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"c{t}{p}")
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    cells = [
        F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"c{t}{p}").alias("n"))
        for t in (0, 1)
        for p in (0, 1)
    ]
    return one.select(F.inline(F.array(*cells)))


def class_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", names: tuple[str, str] = ("0", "1"), digits: int = 3) -> DataFrame:
    """Precision, recall, F1 and support per class, and the three averages."""
    t, p = F.col(truth), F.col(pred)
    counts = df.agg(
        F.count("*").alias("total"),
        *[
            c
            for k in (0, 1)
            for c in (
                F.count_if((t == k) & (p == k)).alias(f"hit{k}"),
                F.count_if(t == k).alias(f"support{k}"),
                F.count_if(p == k).alias(f"picked{k}"),
            )
        ],
    )
    for k in (0, 1):
        counts = counts.withColumn(f"p{k}", safe_ratio(f"hit{k}", f"picked{k}"))
        counts = counts.withColumn(f"r{k}", safe_ratio(f"hit{k}", f"support{k}"))
        both = F.col(f"p{k}") + F.col(f"r{k}")
        counts = counts.withColumn(f"f{k}", safe_ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), both))
    accuracy = safe_ratio(F.col("hit0") + F.col("hit1"), "total")

    def row(name, precision, recall, f1, support):
        rounded = [
            F.round(v.cast("double"), digits).alias(a)
            for v, a in ((precision, "precision"), (recall, "recall"), (f1, "f1"))
        ]
        return F.struct(F.lit(name).alias("class"), *rounded, support.cast("bigint").alias("support"))

    def macro(m):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m):
        return safe_ratio(F.col(f"{m}0") * F.col("support0") + F.col(f"{m}1") * F.col("support1"), "total")

    total = F.col("total")
    rows = [row(names[k], *[F.col(f"{m}{k}") for m in "prf"], F.col(f"support{k}")) for k in (0, 1)]
    rows += [
        row("accuracy", F.lit(None), F.lit(None), accuracy, total),
        row("macro avg", *[macro(m) for m in "prf"], total),
        row("weighted avg", *[weighted(m) for m in "prf"], total),
    ]
    return counts.select(F.inline(F.array(*rows)))


def _errors(df, threshold, k, truth, wanted, order, score, txt, key):
    wrong = predict_at(df, threshold, score).where((F.col(truth) == wanted) & (F.col("y_pred") == 1 - wanted))
    category = F.coalesce(F.col("category").cast("string"), F.lit("N/A")) if "category" in df.columns else F.lit("N/A")
    picked = wrong.orderBy(order, key).limit(k)
    return picked.select(key, score, category.alias("category"), preview(txt, 200).alias("preview"))


def false_positives(df: DataFrame, threshold, k: int = 5, score: str = "score", truth: str = "y_true", txt: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``k`` negatives with the highest score among those predicted positive."""
    return _errors(df, threshold, k, truth, 0, F.desc(score), score, txt, key)


def false_negatives(df: DataFrame, threshold, k: int = 5, score: str = "score", truth: str = "y_true", txt: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``k`` positives with the lowest score among those predicted negative."""
    return _errors(df, threshold, k, truth, 1, F.asc(score), score, txt, key)


def eval_summary(df: DataFrame, dataset: str, positive: str, negative: str, hypothesis: str = "", score: str = "score", truth: str = "y_true") -> DataFrame:
    """One row with the data set, its labels, AUC, AP and optimal threshold.

    All three come from one pass over the per-score counts.
    """
    counts = threshold_counts(df, score, truth)
    p, n = _totals(df, score, truth)
    tp, fp, pos = (F.col(c).cast("double") for c in ("tp", "fp", "pos"))
    j = F.round(F.try_divide(tp, p) - F.try_divide(fp, n), 12)
    best = F.max(F.struct(j.alias("j"), F.col("threshold").alias("t")))
    row = counts.agg(
        _area().alias("roc_auc"),
        safe_ratio(F.sum(pos * tp / (tp + fp)), F.sum("pos")).alias("average_precision"),
        best.alias("b"),
    )
    return row.select(
        F.lit(dataset).alias("dataset"),
        F.lit(hypothesis).alias("hypothesis"),
        F.lit(str(positive)).alias("positive_label"),
        F.lit(str(negative)).alias("negative_label"),
        "roc_auc",
        "average_precision",
        F.when(F.col("b.j") > 0, F.col("b.t")).otherwise(float("inf")).alias("optimal_threshold"),
    )


METRICS = ("accuracy", "precision", "recall", "f1")


def _binary_columns(truth, pred, prefix: str = "") -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    tp = F.count_if((t == 1) & (p == 1))
    precision = safe_ratio(tp, F.count_if(p == 1))
    recall = safe_ratio(tp, F.count_if(t == 1))
    f1 = safe_ratio(2 * tp, F.count_if(t == 1) + F.count_if(p == 1))
    accuracy = safe_ratio(F.count_if(t == p), F.count("*"))
    return [c.alias(prefix + n) for c, n in zip((accuracy, precision, recall, f1), METRICS)]


def binary_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    return df.agg(*_binary_columns(truth, pred))


def compare_models(original: DataFrame, other: DataFrame, key: str = "id", truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``(metric, original, other, delta)`` of two prediction tables."""
    both = original.select(key, F.col(truth).alias("_t"), F.col(pred).alias("_a")).join(
        other.select(key, F.col(pred).alias("_b")), key
    )
    one = both.agg(*_binary_columns("_t", "_a", "a_"), *_binary_columns("_t", "_b", "b_"))
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"a_{m}").alias("original"),
            F.col(f"b_{m}").alias("other"),
            (F.col(f"b_{m}") - F.col(f"a_{m}")).alias("delta"),
        )
        for m in METRICS
    ]
    return one.select(F.inline(F.array(*rows)))


def agreement(original: DataFrame, other: DataFrame, key: str = "id", pred: str = "y_pred") -> DataFrame:
    """Share of equal predictions in percent."""
    both = original.select(key, F.col(pred).alias("_a")).join(other.select(key, F.col(pred).alias("_b")), key)
    return both.agg((F.avg((F.col("_a") == F.col("_b")).cast("double")) * 100).alias("agreement_pct"))
