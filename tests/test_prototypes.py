"""Label scores by prototypes next to plain Python."""

import math
import re
from collections import Counter

import pytest

from textveil.operators import classify as cl
from textveil.operators import prototypes as pr

TEXTS = ["Der Hund bellt laut", "Die Katze schläft", "Hund und Katze, Hund!", "", None, "Regen Regen Regen", "Hund und Katze, Hund!"]


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(texts, examples):
    known = {t for t in texts if t and t.strip()}
    df = Counter(w for t in known for w in set(words(t)))

    def vector(t):
        v = {w: (1 + math.log(n)) * (math.log((1 + len(known)) / (1 + df[w])) + 1) for w, n in Counter(words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    prototypes = {}
    for label, t in examples:
        p = prototypes.setdefault(label, Counter())
        p.update(vector(t))
    out = {}
    for t in texts:
        v = vector(t)
        for label, p in prototypes.items():
            size = math.sqrt(sum(x * x for x in p.values()))
            out[t, label] = sum(x * p[w] for w, x in v.items()) / size if size else 0.0
    return out


def test_scores_are_cosines(spark, frame):
    docs = frame(*TEXTS)
    examples = [("Tiere", "Hund Katze Maus"), ("Tiere", "Hund Katze Maus"), ("Tiere", "der Hund"), ("Wetter", "Regen Sonne"), ("leer", " ")]
    vocabulary = pr.fit_vocabulary(docs)
    shown = spark.createDataFrame(examples + [(None, "Hund")], "label string, text string")
    prototypes = pr.fit_prototypes(shown, vocabulary)
    labels = ["Wetter", "Tiere", "leer", "unbekannt"]
    got = pr.prototype_logits(docs, labels, prototypes, vocabulary, scale=1.0).orderBy("doc_id").collect()
    want = brute(TEXTS, examples)
    for t, r in zip(TEXTS, got):
        assert list(r.logits) == pytest.approx([want.get((t, x), 0.0) for x in labels])
    best = {r.doc_id: (r.label, r.rank) for r in pr.best_hypotheses(docs, prototypes, vocabulary, k=2).collect() if r["rank"] == 1}
    assert best == {1: ("Tiere", 1), 3: ("Tiere", 1), 6: ("Wetter", 1), 7: ("Tiere", 1), **({2: ("Tiere", 1)})}


def test_any_candidate_list_without_examples(spark, frame):
    docs = frame("Regen und Wind", "ein Hund")
    vocabulary = pr.fit_vocabulary(docs)
    labels = ["Hund", "Regen", "Politik"]
    scored = pr.prototype_logits(docs, labels, pr.label_prototypes(labels, vocabulary, "Es geht um {}."), vocabulary)
    done = cl.classify(scored, labels, multi_label=False).orderBy("doc_id").select(cl.top_label("result").alias("t")).collect()
    assert [r.t for r in done] == ["Regen", "Hund"]
