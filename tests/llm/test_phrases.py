"""Collocations next to brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from textveil.llm import phrases
from textveil.llm.frames import importable

LOWER = {65 + i: chr(97 + i) for i in range(26)}


def counted(rows):
    f = {}
    for lang, text in rows:
        of = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                of.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, least, inside, top):
    out = []
    for lang, f in counted(rows).items():
        size = sum(n for p, n in f.items() if len(p) == 1)
        able = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in able.items():
            if any(100 * n >= inside * a for q, n in able.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, size, -s))
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    said = ["out of the Blue moon", "New York city", "ä é ä", "s'il vous plaît"]
    out = [(None, None), ("en", None), ("en", ""), (None, " . ,, \n"), ("xx", "one"), ("en", "x " * 2500), ("en", "a\tb c a\tb c."), ("fr", "a a a a")]
    for _ in range(n):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(said).split()
        text = "".join(w + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "! "]) for w in words)
        out.append((rng.choice(["en", "en", "en", "fr", None, ""]), text))
    return out + out[-3:]


def frame(spark, rows):
    more = [(t, x, i, "y", 0.5) for i, (x, t) in enumerate(rows)]
    return importable(spark).createDataFrame(more, "text string, lang string, n bigint, word string, a double")


@pytest.mark.parametrize("least, inside, top, spread", [(2, 50, 2000, False), (3, 90, 7, False), (2, 50, 2000, True), (5, 10, 50, True)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, least, inside, top, spread):
    if spread:  # nearly every word has its grams in several places
        monkeypatch.setattr(phrases, "LEAST_PART", 10)
        monkeypatch.setattr(phrases, "PARTS", 1000)
    rows = rows_of(least + inside)
    got = phrases.collocations(frame(spark, rows), least=least, inside=inside, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, inside, top)


def test_the_graph_stands_for_all_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PATH_CUT", 3)
    long = " ".join(f"w{i}" for i in range(40))
    rows = rows_of(5) + [("en", f"{long} end{i}.") for i in range(4)]
    graph = phrases.phrase_graph(frame(spark, rows), least=3)
    spelled = {r.w: (r.lang, r.word) for r in graph.vocabulary.collect()}
    want = counted(rows)
    assert sum(r.n for r in graph.vocabulary.collect()) == sum(n for f in want.values() for p, n in f.items() if len(p) == 1)
    pairs, triples = phrases.gram_counts(graph)
    for table, k in ((graph.singles, 1), (pairs, 2), (triples, 3)):
        got = [(spelled[r[0]][0], tuple(spelled[x][1] for x in r[:k]), r["n"]) for r in table.collect()]
        assert sorted(got) == sorted((lang, p, n) for lang, f in want.items() for p, n in f.items() if len(p) == k and n >= 3)
    edges = graph.paths.collect()
    assert max(len(r.words) for r in edges) > 3, "unary nodes are inside of paths"
    assert graph.ends.count() < pairs.count()


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 10**15 - 7, 10**15 - 1, 10**15 - 3
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == int(Fraction(10**6 * a * a, left * right))


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, rows_of(1)).limit(0)).count() == 0
