"""Sums over words, with frequent words sent around and the others joined."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textveil.operators import bayes as by
from textveil.operators import prototypes as pr
from textveil.operators import wordsums
from textveil.operators.wordsums import WordTable, counted_words, sums_by_text

TEXTS = ["a b a c", "c c d", "e", "", "a e e f"]
WEIGHTS = {"a": (9, 2.0), "b": (1, 3.0), "c": (9, 5.0), "d": (1, 7.0), "e": (4, 11.0), "x" * 100: (90, 1.0)}


def test_words_are_counted_within_the_row(frame):
    got = frame(*TEXTS).select(counted_words(by.bayes_tokens("text")).alias("w")).collect()
    assert [Counter({x.word: x.tf for x in r.w or []}) for r in got] == [Counter(t.split()) for t in TEXTS]


@pytest.mark.parametrize("most", [0, 2, 3, 1000])
def test_sums_do_not_depend_on_the_split(spark, frame, most):
    table = spark.createDataFrame([(w, n, x) for w, (n, x) in WEIGHTS.items()], "word string, n int, x double")
    split = WordTable(table, "n", most)
    assert split.held is None or split.held.count() <= most
    weight = F.col("tf") * F.coalesce("x", F.lit(100.0))
    for unknown in (False, True):
        got = {r.doc_id: r.s for r in sums_by_text(frame(*TEXTS), "doc_id", by.bayes_tokens("text"), split, {"s": weight}, unknown).collect()}
        known = {w: x for w, (_, x) in WEIGHTS.items()}
        want = {i: sum(known.get(w, 100.0) for w in t.split() if unknown or w in known) for i, t in enumerate(TEXTS, 1) if t}
        assert got == want


def test_pairs_of_frequent_words_are_not_shuffled(spark, frame):
    table = spark.createDataFrame([(w, n, x) for w, (n, x) in WEIGHTS.items() if len(w) == 1], "word string, n int, x double")
    summed = sums_by_text(frame(*TEXTS).repartition(3, "doc_id"), "doc_id", by.bayes_tokens("text"), WordTable(table, "n"), {"s": F.col("tf") * F.col("x")})
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # that of the texts


def test_rows_of_one_key_are_one_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b"), (None, "b"), (3, None)], "doc_id bigint, text string")
    vocabulary = pr.fit_vocabulary(docs)
    got = pr.tfidf(docs, vocabulary, pr.term_dictionary(vocabulary)).collect()
    assert sorted((r.doc_id, r.id, r.tf) for r in got) == [(1, 0, 2), (1, 1, 1), (2, 1, 1)]
    assert {r.doc_id: 1.0 for r in got} == pytest.approx({k: sum(r.weight**2 for r in got if r.doc_id == k) for k in (1, 2)})


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_frequent_and_rare_words_of_a_text_are_weighed_together(spark, monkeypatch, adaptive):
    monkeypatch.setattr(wordsums, "HELD_ROWS", 2)
    rows = [(i, f"a b c{i % 7} d{i}") for i in range(40)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        vocabulary = pr.fit_vocabulary(docs)
        got = pr.tfidf(docs, vocabulary, pr.term_dictionary(vocabulary)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({(r.doc_id, r.id) for r in got}) == len(got) == 160
    assert {i: sum(r.weight**2 for r in got if r.doc_id == i) for i, _ in rows} == pytest.approx({i: 1.0 for i, _ in rows})
