"""Toxicity from class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give each word a probability from its
letters: the bytes of a word between two marks, each after up to five before it.
A class's own counts are discounted, and what the discount takes goes to a model of
both classes together, itself Kneser-Ney smoothed down to single bytes.  So rare
expressions, which neither class knows, weigh nothing, and unseen forms of known
stems still do.

A text is judged by its most toxic stretch of a few words: the difference of both
models' log-likelihoods there, divided by the stretch's length, next to that of the
whole text.  A text of fewer words is one stretch.  A logistic curve on these two, fitted on training texts that the counts
have not seen, gives the score.

The models learn from a bounded sample of labelled rows: ``fit_rows`` of each class
in the order of a hash of the id, as far as ``fit_bytes`` of text go.  That bounds
the tables, which are broadcast.  The curve's constant is then moved from the odds of
toxic texts in the sample to those in all training rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textveil.llm.frames import bounded_batches, stored
from textveil.llm.memory import held, trimmed
from textveil.llm.quality import fit_logistic
from textveil.llm.words import U, cut_words, raw_bytes, slices, span_hashes, text_of

ORDER = 6
DISCOUNT = 0.75
STRETCH = 4
BEGIN, END = 2, 3  # marks around a word; control signs that no word needs
KNOWN_MOST = 300_000
FIT_WORDS = 20_000  # distinct words whose grams the driver counts at a time


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each predicted byte of marked words: its packed grams of 1 to ORDER bytes.

    Returns the word of each position, how many bytes stand before it (at most
    ORDER - 1) and one array of keys per context length, exact up to 7 bytes.
    """
    size = end - start + 2
    first = np.concatenate(([0], np.cumsum(size)))
    marked = np.empty(first[-1], np.uint8)
    word = np.repeat(np.arange(len(start)), size)
    inside = np.arange(first[-1]) - first[word]
    at = np.repeat(start - 1, size) + inside
    marked[:] = data[np.clip(at, 0, max(0, len(data) - 1))] if len(data) else 0
    marked[first[:-1]], marked[first[1:] - 1] = BEGIN, END
    wide = marked.astype(U)
    keys, packed = [], np.zeros(len(wide), U)
    for k in range(ORDER):
        packed = packed.copy()
        packed[k:] |= wide[: max(0, len(wide) - k)] << U(8 * k)
        keys.append(packed | (U(k + 1) << U(56)))
    predicted = inside > 0
    return word[predicted], np.minimum(inside[predicted], ORDER - 1), [x[predicted] for x in keys]


def _sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at, axis=0) if len(at) else weights[:0]


def _context(keys: np.ndarray) -> np.ndarray:
    """The context of a gram as a key of its own; 0x80 in the tag keeps the two apart."""
    length = keys >> U(56)
    return ((keys & U((1 << 56) - 1)) >> U(8)) | ((length | U(0x80)) << U(56))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def fit_models(words: pa.Array | list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of both classes and of their shared model, from counts of words."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    full, counts = np.zeros(0, U), np.zeros((0, 2))
    grams, sums = [], []
    for k in range(0, len(words), FIT_WORDS):
        data, offsets = raw_bytes(words.slice(k, FIT_WORDS).cast(pa.large_binary()).view(pa.large_string()))
        word, before, keys = _grams(data, offsets[:-1], offsets[1:])
        each = np.column_stack([toxic[k : k + FIT_WORDS], ordinary[k : k + FIT_WORDS]]).astype(float)[word]
        g, n = _sum_by(np.choose(before, keys), each)
        grams.append(g)
        sums.append(n)
        if len(grams) == 8 or k + FIT_WORDS >= len(words):
            full, counts = _sum_by(np.concatenate([full, *grams]), np.concatenate([counts, *sums]))
            grams, sums = [], []
    tables: dict[str, np.ndarray] = {}
    for c, name in enumerate(("toxic", "ordinary")):
        g, n = _sum_by(full, counts[:, c])
        g, n = g[n > 0], n[n > 0]
        h, total = _sum_by(_context(g), n)
        _, types = _sum_by(_context(g), np.ones(len(g)))
        at, _ = _find(h, _context(g))
        tables[name], tables[name + "_p"] = g, np.maximum(n - DISCOUNT, 0) / total[at] if len(g) else n
        tables[name + "_h"], tables[name + "_b"] = h, DISCOUNT * types / total
    # shared: counts of the longest grams, and of distinct longer grams below
    g, n = _sum_by(full, counts.sum(1))
    g, n = g[n > 0], n[n > 0]
    grams, direct, contexts, back = [], [], [], []
    for k in range(ORDER, 0, -1):
        own = (g >> U(56)) == U(k)
        level, m = g[own], n[own]
        h, total = _sum_by(_context(level), m)
        _, types = _sum_by(_context(level), np.ones(len(level)))
        at, _ = _find(h, _context(level))
        grams.append(level)
        direct.append(np.maximum(m - DISCOUNT, 0) / total[at] if len(level) else m)
        contexts.append(h)
        back.append(DISCOUNT * types / total if len(h) else total)
        if k > 1:
            mask = U((1 << (8 * (k - 1))) - 1)
            below, seen = _sum_by((level & mask) | (U(k - 1) << U(56)), np.ones(len(level)))
            g, n = _sum_by(np.concatenate([g[~own], below]), np.concatenate([n[~own], seen]))
    for name, (a, b) in {"shared": (grams, direct), "shared_h": (contexts, back)}.items():
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(a)
        tables[name], tables[name + "_p"] = a[order], b[order]
    return tables


def word_log_likelihoods(tables: dict[str, np.ndarray], data, start, end) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability of each word under the toxic and the ordinary model."""
    if not len(start):
        return np.zeros(0), np.zeros(0)
    word, before, keys = _grams(data, start, end)
    full = np.choose(before, keys)
    distinct, back_to = np.unique(full, return_inverse=True)
    length = (distinct >> U(56)).astype(np.int64)
    shared = np.full(len(distinct), 1 / 256)
    for k in range(1, ORDER + 1):
        own = length >= k
        part = (distinct[own] & U((1 << (8 * k)) - 1)) | (U(k) << U(56))
        at, seen = _find(tables["shared_h"], _context(part))
        ga, gs = _find(tables["shared"], part)
        p = shared[own]
        if len(tables["shared_h"]):
            p = np.where(seen, tables["shared_h_p"][at] * p, p)
        if len(tables["shared"]):
            p = np.where(gs, p + tables["shared_p"][ga], p)
        shared[own] = p
    out = []
    for name in ("toxic", "ordinary"):
        at, seen = _find(tables[name + "_h"], _context(distinct))
        ga, gs = _find(tables[name], distinct)
        p = shared
        if len(tables[name]):
            p = np.where(seen, tables[name + "_b"][at] * shared, shared) + np.where(gs, tables[name + "_p"][ga], 0)
        out.append(np.bincount(word, np.log(p)[back_to], minlength=len(start)))
    return out[0], out[1]


class Seen:
    """Likelihoods of words that a Python worker has met, by hash."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables = tables
        self.keys, self.values = np.zeros(0, U), np.zeros((0, 2))

    def look_up(self, data, start, end) -> np.ndarray:
        if len(self.keys) > KNOWN_MOST:
            self.keys, self.values = np.zeros(0, U), np.zeros((0, 2))
        keys = span_hashes(data, start, end)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, sample = ranked[new], order[new]
        at, known = _find(self.keys, distinct)
        if not known.all():
            pick = sample[~known]
            got = np.column_stack(word_log_likelihoods(self.tables, data, start[pick], end[pick]))
            place = np.searchsorted(self.keys, distinct[~known])
            self.keys = np.insert(self.keys, place, distinct[~known])
            self.values = np.insert(self.values, place, got, axis=0)
            at = np.searchsorted(self.keys, distinct)
        out = np.empty((len(keys), 2))
        out[order] = self.values[at][np.cumsum(new) - 1]
        return out


def text_measures(texts: pa.Array, seen: Seen) -> np.ndarray:
    """Per text: highest difference of a stretch and of the whole, both by word; toxic and ordinary log-likelihood by word."""
    w = cut_words(texts)
    n = len(w.offsets) - 1
    both = seen.look_up(w.data, w.start, w.end)
    count = np.diff(w.first)
    sums = np.concatenate((np.zeros((1, 2)), np.cumsum(both, axis=0)))
    mean = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(count, 1)[:, None]
    doc = text_of(w.first)
    gap = sums[:, 0] - sums[:, 1]
    # the stretch that begins at each word, or so far before as to end with the text; a text of fewer words is one
    size = np.minimum(STRETCH, count)[doc]
    start = np.minimum(np.arange(len(doc)), w.first[doc + 1] - size)
    value = (gap[start + size] - gap[start]) / size
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, value)
    top[count == 0] = 0
    return np.column_stack([top, mean[:, 0] - mean[:, 1], mean])


def _seen(model) -> Seen:
    key, tables = model.value
    return held(("toxicity", key), lambda: Seen(tables))


def _measured(model, text: str = "text") -> Column:
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [text_measures(x.column("text"), _seen(model)) for x in slices([batch], "text", 1 << 20)]
        table = np.concatenate(parts) if parts else np.zeros((0, 4))
        trimmed()
        return pa.array(list(table), pa.list_(pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(text)


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        w = cut_words(part.column("text"))
        y = part.column("_y").to_numpy()[text_of(w.first)]
        keys = span_hashes(w.data, w.start, w.end)
        order = np.argsort(keys)
        ranked = keys[order]
        at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
        toxic = np.add.reduceat(y[order], at) if len(at) else at
        total = np.diff(np.append(at, len(keys)))
        words = [bytes(w.data[w.start[i] : w.end[i]]) for i in order[at]]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic, pa.int64()), pa.array(total - toxic, pa.int64())], ["word", "toxic", "ordinary"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 4000, fit_bytes: int = 16 << 20):
    """A broadcast model and the curve's three numbers, from labelled rows for which ``train`` holds.

    Without training rows of both classes the score is 0.5 for every text.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(train)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_y"))
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    some = stored(some[0].unionByName(some[1]), "fit-ids")
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null"), "fit-texts")
    sizes = texts.select("doc_id", "_y", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(4 * fit_rows).collect()
    fit, check, room, taken = [], [], [fit_bytes, fit_bytes], [0, 0]
    for i, r in enumerate(sizes):
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            taken[r["_y"]] += 1
            (check if i % 4 == 0 else fit).append(r["h"])
    # as an Arrow table: a list of rows would go through Python workers of another kind, which stay beside the others
    ids = pa.table({"h": pa.array(fit + check, pa.int64()), "_check": pa.array([False] * len(fit) + [True] * len(check), pa.bool_())})
    ids = spark.createDataFrame(ids)
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(ids), "h")
    counts = texts.where("not _check").select("text", "_y").mapInArrow(_word_counts, "word binary, toxic bigint, ordinary bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    counts = counts.take(pc.sort_indices(counts, [("word", "ascending")])).combine_chunks()
    toxic, ordinary = (counts.column(c).to_numpy() for c in ("toxic", "ordinary"))
    words = counts.column("word").combine_chunks()
    tables = fit_models(words if isinstance(words, pa.Array) else words.chunk(0), toxic, ordinary)
    model, any_toxic = spark.sparkContext.broadcast((uuid.uuid4().hex, tables)), bool(toxic.any())
    del counts, words, toxic, ordinary, tables
    rows = texts.where("_check").select(_measured(model).alias("x"), "_y", "h").collect()
    y = np.array([r["_y"] for r in rows], float)
    if len(set(y.tolist())) < 2 or not any_toxic:
        return model, [0.0, 0.0, 0.0]
    x = np.array([r["x"][:2] for r in rows])
    order = np.lexsort((x[:, 1], x[:, 0], [r["h"] for r in rows]))
    curve = fit_logistic(x[order], y[order], ridge=0.1).tolist()
    # all training rows with a text, against those that the bounds let through
    present = docs.where("text is not null").select("doc_id").join(known, "doc_id").groupBy("_y").count().collect()
    whole = {r["_y"]: r["count"] for r in present}
    curve[2] -= float(np.log(taken[1] / taken[0]) - np.log(whole[1] / whole[0]))
    return model, curve


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = 0.7, **bounds) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1), predicted, toxic_ll and ordinary_ll (by word).

    ``train`` chooses rows of ``labels`` to learn from (all if left out).  Labels and
    other columns than the text are never inputs of a score.

    Null and empty texts and texts without words score as if both models found them
    equally likely.  Repeated rows and ties score alike.  An empty table gives an
    empty result.  Columns called like an added one are replaced.
    """
    added = ["score", "predicted", "toxic_ll", "ordinary_ll"]
    docs = docs.drop(*added)
    bounded_batches(docs.sparkSession)
    model, (a, b, c) = fit_toxicity(docs, labels, F.lit(True) if train is None else train, **bounds)
    x = docs.withColumn("_x", _measured(model))
    score = 1 / (1 + F.exp(-(a * F.col("_x")[0] + b * F.col("_x")[1] + c)))
    out = x.withColumns({"score": score, "toxic_ll": F.col("_x")[2], "ordinary_ll": F.col("_x")[3]})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*docs.columns, *added)
