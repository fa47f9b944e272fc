"""Batch look-ups next to patterns and plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textveil.functions.lookup import SPANS, Terms, find_terms, find_terms_as_of, mask_words, without_overlaps
from textveil.functions.regex import whole_words
from textveil.operators import anonymize as an
from textveil.operators.dictionary import held_lists, words_frame
from textveil.operators.scrub import scrub

ALPHABET = ["a", "b", "é", "ß", "😀", "-", "_", "7", "²", ".", " ", " "]


def texts_of(seed, n=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "a" * 3000 + " ab"]


def norm(token):
    return "".join(c for c in token if c == "_" or re.match(r"\w", c))


def test_words_are_masked_like_token_by_token(spark, frame):
    texts = [re.sub(" +", " ", t).strip() for t in texts_of(1)]
    lists = [(["ab", "é7", "_", "²"], "<1>"), (["ba", "ab", "ßa", ""], "<2>")]
    got = frame(*texts).select("doc_id", mask_words("text", lists).alias("t")).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        want = [next((m for ws, m in lists if norm(t) in ws and norm(t)), t) for t in text.split(" ")]
        assert row.t == " ".join(want)
    nothing = spark.createDataFrame([(None,), ("ab",)], "text string").select(mask_words("text", lists).alias("t")).collect()
    assert [r.t for r in nothing] == [None, "<1>"]


def brute_terms(text, terms, merge):
    """The leftmost longest hits at word boundaries, by trying every place."""
    def longest(i):
        if i and norm(text[i - 1]):
            return 0
        ends = [i + len(t) for t in terms if t and text.startswith(t, i) and not (i + len(t) < len(text) and norm(text[i + len(t)]))]
        return max(ends, default=0)

    out, i = [], 0
    while i < len(text):
        end = longest(i)
        if not end:
            i += 1
            continue
        while merge and text[end : end + 1] == " " and longest(end + 1):
            end = longest(end + 1)
        out.append((i, end))
        i = end
    return out


@pytest.mark.parametrize("merge", [False, True])
def test_terms_are_found_like_place_by_place(frame, merge):
    rng = random.Random(3)
    terms = ["a", "a b", "ab", "é.", ".", "b a b", "😀", "7-", ""] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 5))) for _ in range(20)]
    texts = texts_of(2)
    kinds = [Terms("X", terms, 0.5, merge), Terms("Y", ["ab", "b"], 1.0, not merge)]
    rows = frame(*texts).select("text", find_terms("text", kinds).alias("s")).collect()
    for r in rows:
        want = [("X", a, b, 0.5, r.text[a:b]) for a, b in brute_terms(r.text, terms, merge)]
        want += [("Y", a, b, 1.0, r.text[a:b]) for a, b in brute_terms(r.text, ["ab", "b"], not merge)]
        assert [tuple(s) for s in r.s] == want


def test_lists_of_every_size_take_one_way(frame):
    df = frame("bei Nordlicht Labor und Nordlicht, Nordlichter", "Nordlicht", "")
    base = ["Nordlicht Labor", "Nordlicht"]
    found = []
    for n in (8, 999, 99_998):
        terms = base + [f"wort{i} mit{i}" if i % 2 else f"wort{i}" for i in range(n)]
        found.append([r.s for r in an.with_deny_spans(df, "text", terms, out="s").orderBy("doc_id").collect()])
        assert "ArrowEvalPython" in an.with_deny_spans(df, "text", terms)._jdf.queryExecution().toString()
    assert found[0] == found[1] == found[2]
    assert [s.text for s in found[0][0]] == ["Nordlicht Labor", "Nordlicht"]


def test_lists_too_large_to_hold_are_cut_and_then_joined(frame):
    df = frame("Weber a b.", "c Ulm-Weber", "Klinik am See, Klinik")
    words = df.select(F.explode(F.split("text", " ")).alias("word"))
    assert held_lists(df, F.split("text", " "), [["Weber", "x"], ["y"]], "join") == [["Weber"], []]
    assert held_lists(df, F.split("text", " "), [words], "join", most=2) is None
    kinds = [("K", ["Klinik am See", "Klinik", "Klinik am"], 1.0, False), ("W", ["Weber"], 0.5, False)]
    ways = [an.with_term_spans(df, "text", kinds, "s", how, most).orderBy("doc_id").collect() for how, most in (("auto", None), ("join", None), ("auto", 1))]
    assert ways[0] == ways[1] == ways[2]
    assert [s.text for s in ways[0][2].s] == ["Klinik am See", "Klinik"]


def test_cut_lists_keep_words_that_rules_make(frame):
    df = frame("x@example.com,Abt Abt", "Weber")
    names = ["EMAILAbt", "Abt", "Weber"]
    got = [scrub(df, names=names, strategy=s).orderBy("doc_id").collect() for s in ("auto", "join")]
    assert got[0] == got[1] and got[0][0].text == "[PERSON] [PERSON]"


def test_list_of_the_rows_own_time(spark):
    rows = [(0, "a b c"), (10, "a b c"), (15, "a b c"), (20, "a b c"), (None, "a b c"), (99, None)]
    df = spark.createDataFrame(rows, "t bigint, text string")
    versions = [(20, Terms("X", ["c", "b c"], 1.0)), (10, Terms("X", ["a"], 1.0))]
    got = df.select("t", find_terms_as_of("text", "t", versions).alias("s")).collect()
    assert [[s.text for s in r.s] for r in got] == [[], ["a"], ["a"], ["b c"], [], []]


def test_versions_of_a_list(spark, frame):
    listed = spark.createDataFrame([("2024-01-02", "b"), ("2024-01-03", "a"), ("2024-01-03", "a b")], "v string, term string")
    listed = listed.select(F.col("v").cast("timestamp").alias("valid_from"), "term")
    df = frame("a b", "a b", "a b").withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("doc_id").cast("string"))))
    got = an.anonymize(df, recognizers=[], deny_as_of=("ts", listed)).orderBy("doc_id").select("result.anonymized_text").collect()
    assert [r[0] for r in got] == ["a b", "a <INTERN>", "<INTERN>"]
    none = an.anonymize(df, recognizers=[], deny_as_of=("ts", listed.limit(0))).select("result.items_changed").collect()
    assert {r[0] for r in none} == {0}


def chain(k):
    """Spans that each overlap the next, inside a long one."""
    return [("ALL", 0, 2 * k + 2, 0.4, "")] + [("W", 2 * i, 2 * i + 3, 0.9 if i % 2 else 0.5, "") for i in range(k)]


def test_long_clusters_take_the_work_of_sorting(spark):
    took = []
    for k in (16_000, 32_000):
        df = spark.createDataFrame([(chain(k),)], f"s {SPANS}").cache()
        df.count()
        start = time.time()
        kept = df.select(without_overlaps("s").alias("k")).first().k
        took.append(time.time() - start)
        assert [s.start for s in kept] == [2 * i for i in range(k) if i % 2]
    assert took[1] < 2.5 * max(took[0], 1.0)


def test_type_counts_are_those_of_detect(frame):
    df = frame("12345 a@b.de Dr. Weber 12345", "", "Herr Abt, Nordlicht 1998", "x").withColumn("g", F.col("doc_id") % 2)
    options = {"deny_terms": ["Nordlicht"], "gazetteers": {"LOCATION": ["Abt", "x"]}}
    want = an.audit_counts(an.detect(df, **options), ["g"])
    assert sorted(map(tuple, an.count_by_type(df, ["g"], **options).collect())) == sorted(map(tuple, want.collect()))
    rolled = an.audit_rollup(an.detect(df, **options), "g")
    assert sorted(map(str, an.count_by_type(df, ["g"], rollup=True, **options).collect())) == sorted(map(str, rolled.collect()))
    assert an.count_by_type(df, min_score=0.9, recognizers=[an.PHONE]).count() == 0


def test_whole_words_and_terms_agree(frame):
    texts = texts_of(5)
    rows = frame(*texts).select("text", find_terms("text", [Terms("X", ["ab", "a"], 1.0)]).alias("s"), F.regexp_extract_all("text", F.lit(whole_words("ab|a")), F.lit(0)).alias("m")).collect()
    assert all([s.text for s in r.s] == r.m for r in rows)


def test_only_looked_up_words_are_gathered(frame, monkeypatch):
    from textveil.functions.text import words
    from textveil.operators import dictionary as dic

    gathered = []

    def kept(df, name):
        gathered.append(sorted(r.word for r in df.collect()))
        return df

    monkeypatch.setattr(dic, "kept", kept)
    docs = frame("Anna und Bert", "Bert kennt Carl", None, "")
    lists = [["Bert", "Dora"], ["Carl", "Bert"]]
    found = dic.held_lists(docs, words("text"), lists, strategy="join")
    assert [sorted(x) for x in found] == [["Bert"], ["Bert", "Carl"]]
    assert gathered == [["Bert", "Carl"]]  # once for both lists
    monkeypatch.setattr(dic, "_small", lambda entries, *_: "list" in entries.columns)  # as if the entries' words were too many
    again = dic.held_lists(docs, words("text"), lists, strategy="join")
    assert [sorted(x) for x in again] == [["Bert"], ["Bert", "Carl"]]
    assert gathered[1] == ["Anna", "Bert", "Carl", "kennt", "und"]
