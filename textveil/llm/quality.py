"""Quality of documents by hierarchical empirical Bayes.

Three kinds of evidence meet as log-odds: a classifier on the document's own
text, how its path (here: host and language) is doing, and how its host is
doing.  Rates of sparse hosts shrink toward the global rate and rates of sparse
paths toward their host; how strongly is itself estimated from the spread of the
groups (method of moments for a beta prior).

The classifier is a logistic regression on measures of the text, fitted on a
bounded sample of labelled rows (``fit_rows``).  Everything else covers all rows:
labelled documents count with their label, the others with the classifier's
probability, summed by group before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textveil.llm.frames import bounded_batches, stored, with_group_values
from textveil.llm.memory import forgotten, trimmed
from textveil.llm.words import cut_words, slices, span_hashes, text_of

FIT_ROWS = 10_000
SIGNS = np.isin(np.arange(256), np.frombuffer(b"!#$%&*+<=>@[]^_{|}~\\", np.uint8))
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)


def measures(texts: pa.Array) -> np.ndarray:
    """One row of twelve numbers per text; an empty text has zeros."""
    forgotten()
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    table = np.concatenate([np.zeros((0, 12)), *(_measures(x.column("text")) for x in slices([batch], "text", 1 << 20))])
    trimmed()
    return table


def _measures(texts: pa.Array) -> np.ndarray:
    w = cut_words(texts, lower=False)
    n = len(w.offsets) - 1
    size = np.diff(w.offsets)
    chars = np.maximum(size, 1)
    hashes = span_hashes(w.data, w.start, w.end)
    doc, words = text_of(w.first), np.diff(w.first)
    least = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask[w.data], dtype=np.int64)))
        return np.diff(sums[w.offsets]) / chars

    def per_word(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of[flags], minlength=n) / least

    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lengths = (w.end - w.start).astype(float)
    mean = np.bincount(doc, lengths, minlength=n) / least
    square = np.bincount(doc, lengths**2, minlength=n) / least
    letters = np.maximum(share(LETTER), 1e-9)
    last_sign = SIGNS[w.data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    newline = np.arange(256) == 10
    stop = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
    table = np.column_stack(
        [
            np.log1p(words), per_word(new, d) ** 2, per_word(again, doc), share(SIGNS), np.minimum(share(UPPER) / letters, 1),
            share(DIGIT), mean, np.sqrt(np.maximum(square - mean**2, 0)), share(newline), share(stop), per_word(last_sign, doc),
            per_word(new, d),
        ]
    )
    return np.where(size[:, None] > 0, table, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights for columns of ``x`` and, last, the constant; Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-3
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (p - y) + keep * b
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] * mean / scale).sum())


def _measured(text: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(measures(texts)), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)


def fit_document_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[float]:
    """Weights from at most ``fit_rows`` labelled rows, in the order of a hash of the id.

    Without rows of both classes all weights are 0: every text is as likely good
    as bad.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    both = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = both.select(_measured("text").alias("x"), "_y", "doc_id").limit(2 * fit_rows).collect()
    y = np.array([float(r["_y"] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        return [0.0] * 13
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((x[:, 0], [r["doc_id"] for r in rows]))
    return fit_logistic(x[order], y[order]).tolist()


def document_log_odds(weights: Sequence[float], text: str = "text") -> Column:
    """The classifier's log-odds that a text is good, within 8 either way."""
    b = np.array(weights)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(measures(texts) @ b[:-1] + b[-1], -8.0, 8.0))

    return F.arrow_udf(run, "double")(text)


def _strength(groups: DataFrame, rate: Column, prior: Column) -> float:
    """How many documents the prior counts for: large when groups differ little."""
    n = F.col("n")
    r = groups.select(n, (n * (rate - prior) ** 2).alias("v"), (prior * (1 - prior)).alias("b")).agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("v").alias("v"),
        (F.sum(n * F.col("b")) / F.sum("n")).alias("b"), (F.sum(n * n) / F.sum("n")).alias("q"),
    ).first()
    if not r["n"] or r["g"] < 2 or r["n"] - r["q"] <= 0:
        return 1e6
    between = (r["v"] - (r["g"] - 1) * r["b"]) / (r["n"] - r["q"])
    if between <= 1e-9:
        return 1e6
    return float(min(1e6, max(1.0, r["b"] / between - 1)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """Rate of good documents per host and path after shrinking.

    ``evidence``: host, path, p (0 to 1).  One row per path with n, the shrunk
    rates ``host_rate`` and ``path_rate``, and ``global_rate``.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mu = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    k = _strength(hosts, F.col("good") / F.col("n"), F.lit(mu))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + k * mu) / (F.col("n") + k)).alias("host_rate"))
    # hosts of many paths: their rows are split by path as well
    n_paths = paths.count()
    sizes = paths.groupBy("host").agg(F.count("*").alias("_paths"))
    hosts = hosts.join(sizes, F.col("_host").eqNullSafe(F.col("host"))).select("host", "host_rate", "_paths")
    both = with_group_values(paths, hosts, ["host"], "_paths", n_paths).drop("_paths")
    j = _strength(both, F.col("good") / F.col("n"), F.col("host_rate"))
    rate = (F.col("good") + j * F.col("host_rate")) / (F.col("n") + j)
    return both.select("host", "path", "n", "host_rate", rate.alias("path_rate"), F.lit(mu).alias("global_rate"))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    fit_rows: int = FIT_ROWS,
    threshold: float = 0.5,
) -> DataFrame:
    """All columns of ``docs`` and what is known of each document's quality.

    Added: doc_log_odds, host_rate, path_rate, quality_score (0 to 1) and keep
    (score at least ``threshold``).  ``host`` defaults to the column source and
    ``path`` to lang.

    An empty or null text has the measures of an empty text; null hosts and paths
    are groups of their own; repeated rows count as often as they occur; without
    labels every document scores 0.5; an empty table gives an empty result.
    Columns of ``docs`` that are called like an added one are replaced.
    """
    added = ["doc_log_odds", "host_rate", "path_rate", "quality_score", "keep"]
    docs = docs.drop(*added)
    bounded_batches(docs.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    weights = fit_document_classifier(docs, labels, fit_rows)
    # never null, and Spark is told so: else a filter on the score has each text measured once more, by a second worker, to look for nulls
    doc_odds = F.coalesce(document_log_odds(weights), F.lit(0.0))
    rows = docs.withColumns({"_h": host.cast("string"), "_p": path.cast("string"), "doc_log_odds": doc_odds})
    odds = F.col("doc_log_odds")
    narrow = stored(rows.select("doc_id", "_h", "_p", "doc_log_odds"), "evidence")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    seen = narrow.join(known, "doc_id", "left")
    p = F.coalesce(F.when(F.col("_y") > 0, 1.0).when(F.col("_y") <= 0, 0.0), 1 / (1 + F.exp(-odds)))
    sites = stored(site_posteriors(seen.select(F.col("_h").alias("host"), F.col("_p").alias("path"), p.alias("p"))), "sites")
    groups = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("n").alias("_sized"), "host_rate", "path_rate", F.col("global_rate").alias("_global"))
    placed = with_group_values(rows, groups, ["_h", "_p"], "_sized", narrow.count())
    total = odds + _logit(F.col("path_rate")) - _logit(F.col("_global"))
    score = 1 / (1 + F.exp(-total))
    return placed.withColumn("quality_score", score).withColumn("keep", score >= threshold).select(
        *docs.columns, *added
    )
