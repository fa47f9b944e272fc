import random
import re

from pyspark.sql import functions as F

from textveil.functions.regex import portable_regex
from textveil.functions.spans import SPAN_DDL, pattern_spans, regex_spans, replace_spans, resolve_overlaps
from textveil.operators import anonymize as an


def one(df):
    return df.select("result.*").first()


def test_documented_example(frame):
    r = one(an.anonymize(frame("Ich heiße Peter Müller und wohne in 12345 Berlin."), gazetteers={"PERSON": ["Peter", "Müller"], "LOCATION": ["Berlin"]}))
    assert r.anonymized_text == "Ich heiße <PERSON> und wohne in <PLZ> <ORT>."
    assert (r.original_length, r.items_changed) == (49, 3)
    assert [(e.entity_type, e.text) for e in r.entities] == [("PERSON", "Peter Müller"), ("GERMAN_ZIP", "12345"), ("LOCATION", "Berlin")]


def test_longest_deny_term_wins(frame):
    terms = ["Nordlicht Labor", "Nordlicht Praxis", "Nordlicht"]
    r = one(an.anonymize(frame("Nordlicht Labor ist gut, Nordlichter nicht"), deny_terms=terms))
    assert r.anonymized_text == "<INTERN> ist gut, Nordlichter nicht"


def test_empty_text_and_whitespace_kept(frame):
    rows = an.anonymize(frame("", "a \n b  12345 ")).orderBy("doc_id").select("result.*").collect()
    assert tuple(rows[0]) == ("", 0, 0, [])
    assert rows[1].anonymized_text == "a \n b  <PLZ> "


def test_detections_counted_before_overlaps(frame):
    r = one(an.anonymize(frame("PLZ 01067")))
    assert r.items_changed == 2 and r.anonymized_text == "PLZ <PLZ>"


def test_deny_list_by_join_agrees(frame):
    terms = ["C++", "Klinik am See", "Klinik", "++", "a.b"]
    df = frame("In C++ und der Klinik am See.", "Kliniken ++ a.b axb", "😀 Klinik", "")
    want = df.select("doc_id", an.deny_list_spans("text", terms).alias("s")).orderBy("doc_id").collect()
    got = an.with_deny_spans(df, "text", terms, out="s").select("doc_id", "s").orderBy("doc_id").collect()
    assert want == got
    assert [s.text for s in want[0].s] == ["C++", "Klinik am See"]


def test_offsets_like_finditer(frame):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 2😀é.") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    for pattern in (r"\d+", r"\b\w", r"[ab]{2}"):
        rows = frame(*texts).select("text", pattern_spans("text", pattern, "X", 0.5).alias("s")).collect()
        for r in rows:
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.text)]
            assert [(s.start, s.end, s.text) for s in r.s] == want


def brute_force(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], -(s[2] - s[1]), s[1], s[0])):
        if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_overlap_resolution_against_brute_force(spark):
    rng = random.Random(2)
    cases = []
    for _ in range(150):
        spans = set()
        for _ in range(rng.randrange(0, 12)):
            a = rng.randrange(0, 30)
            spans.add((rng.choice("ABC"), a, a + rng.randrange(1, 9), rng.choice([0.4, 0.85, 1.0]), ""))
        cases.append((len(cases), list(spans)))
    df = spark.createDataFrame(cases, f"id int, spans array<{SPAN_DDL}>")
    rows = df.withColumn("kept", resolve_overlaps("spans")).collect()
    for r in rows:
        assert [tuple(s) for s in r.kept] == brute_force([tuple(s) for s in r.spans])


def test_replacement_keeps_the_rest(spark):
    text = "x😀yz"
    df = spark.createDataFrame([(text, [("ORG", 1, 2, 1.0, "😀"), ("NEW", 3, 4, 1.0, "z")])], f"text string, s array<{SPAN_DDL}>")
    assert df.select(replace_spans("text", "s")).first()[0] == "x<ORG>y<DATEN>"


def test_external_spans(spark, frame):
    run = spark.createDataFrame(
        [(1, "ORG", 0, 3, 0.5), (1, "ORG", 0, 3, 0.9), (1, "ORG", 2, 99, 0.9), (1, "LOC", 4, 5, 0.3)],
        "doc_id bigint, entity_type string, start int, end int, score double",
    )
    r = one(an.anonymize(frame("abc d"), recognizers=[], external=run))
    assert r.anonymized_text == "<ORG> d" and r.entities[0].score == 0.9


def test_gazetteer_strategies_agree_and_merge(frame):
    df = frame("Peter Müller, Peter  Müller Petersen", "MüllerPeter Peter-Müller", "Berlin Peter Berlin")
    g = {"PERSON": ["Peter", "Müller"], "LOCATION": ["Berlin", "Peter"]}
    a = an.with_gazetteer_spans(df, "text", g, out="s").orderBy("doc_id").collect()
    b = an.with_gazetteer_spans(df, "text", g, out="s", strategy="join").orderBy("doc_id").collect()
    assert a == b
    assert [s.text for s in a[0].s if s.entity_type == "PERSON"] == ["Peter Müller", "Peter", "Müller"]


def test_audit_has_no_text(frame):
    found = an.detect(frame("12345 12345", "x", "a@b.de"))
    counts = an.audit_counts(found)
    assert counts.columns == ["entity_type", "n"]
    assert {tuple(r) for r in counts.collect()} == {("GERMAN_ZIP", 2), ("EMAIL_ADDRESS", 1)}


def test_reload(spark, tmp_path):
    (tmp_path / "deny.txt").write_text("Eins\n\n Zwei \nEins\n", encoding="utf-8")
    active = an.DenyList(spark, str(tmp_path / "deny.txt"))
    assert active.status() == {"success": True, "entry_count": 3, "entries": ["Eins", "Zwei", "Eins"]}
    assert active.reload(["x"])["entries"] == ["x"]
    assert active.reload()["entry_count"] == 3


def test_user_recognizer(frame):
    mine = an.Recognizer("ORG", (("gmbh", r"\b\w+ GmbH\b", 0.7), ("ag", r"\b\w+ AG\b", 0.3)))
    r = one(an.anonymize(frame("Firma Muster GmbH und Beispiel AG"), recognizers=[mine]))
    assert r.anonymized_text == "Firma <ORG> und Beispiel AG"
    assert an.detect(frame("x"), recognizers=[]).select(F.size("spans")).first()[0] == 0


def test_many_matches_in_one_text(frame):
    # more than one block of spans, and of clusters of overlapping ones
    r = one(an.anonymize(frame("PLZ 01067, " * 700)))
    assert r.anonymized_text == "PLZ <PLZ>, " * 700 and r.items_changed == 1400


def test_lists_of_any_size_and_rows_without_id(frame):
    df = frame("bei Nordlicht Labor", "bei Nordlicht", "").withColumn("doc_id", F.lit(None).cast("int"))
    terms = ["Nordlicht Labor"] + [f"wort{i}" for i in range(1200)] + [" ".join(["lang"] * 120)]
    rows = an.anonymize(df, deny_terms=terms, recognizers=[]).select("result.anonymized_text").collect()
    assert sorted(r[0] for r in rows) == ["", "bei <INTERN>", "bei Nordlicht"]


def test_many_matches_need_one_pass_and_short_pieces(spark):
    """Offsets and replacements as in Python, the text searched once, also where it holds the mark."""
    texts = ["ä😀 12345 x" * 700, "12345", "a\x0112345\x01 123456 12345", "\x01", "", "12345 " * 16, "12345 " * 17, "12345 " * 257, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = regex_spans("text", portable_regex(r"\b\d{5}\b"), "GERMAN_ZIP", 1.0)
    got = df.select("text", spans.alias("s")).select("text", "s", replace_spans("text", "s").alias("r"))
    rows = got.collect()
    for t, r in zip(texts, rows):
        want = [m.span() for m in re.finditer(r"\b\d{5}\b", t or "")]
        assert [(s.start, s.end) for s in r.s] == want and all(s.text == t[s.start : s.end] for s in r.s)
        assert r.r == (t if t is None else re.sub(r"\b\d{5}\b", "<PLZ>", t))
    assert "(?<=" not in portable_regex(r"\b\d{5}\b") and "regexp_replace" in str(spans)
