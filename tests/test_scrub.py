import re

import pytest
from pyspark.sql import functions as F

from textveil.constants import SCRUB_RULES
from textveil.functions.regex import portable_regex, quote_literal
from textveil.functions.text import fill_template, norm_token, squash_ws, strip_quotes, tokens, truncate_tokens
from textveil.operators.dictionary import clean_word_list, held_words, words_frame
from textveil.operators.scrub import apply_rules, mask_by_join, scrub

GOLDEN = [
    (
        "Ich heiße Thomas, wohne in Berlin und meine KV-Nummer ist A123456789. Ruf mich an unter 0176 12345678.",
        "Ich heiße Thomas, wohne in Berlin und meine KV-Nummer ist [MEDICAL_ID]. Ruf mich an unter [PHONE].",
    ),
    (
        "Ich heiße Thomas Müller, wohne in Berlin und meine KV-Nummer ist A123456789.",
        "Ich heiße Thomas [PERSON] wohne in Berlin und meine KV-Nummer ist [MEDICAL_ID].",
    ),
    ("DE89 3704 0044 0532 0130 00", "[IBAN]"),
    ("am 01.02.2020 in Hauptstraße 12a", "am 01.02.[DATE_YEAR] in [STREET]"),
    ("Hauptstraße 1945", "Hauptstraße [DATE_YEAR]"),
    ("Berliner Straße 5", "Berliner Straße 5"),
    ("PLZ 12345 und 01067", "PLZ [NUM] und [PHONE]"),
    ("+1 (743) 555-3824", "+1 ([NUM]) [NUM]-[NUM]"),
    ("max0176123@x.de", "max[PHONE]@x.de"),
    ("  viel \n\t Raum   ", "viel Raum"),
    ("Müller-Schmidt Müller's", "Müller-Schmidt Müller's"),
    ("", ""),
]


def test_golden(frame):
    out = scrub(frame(*[g[0] for g in GOLDEN]), names=["Müller", "Schmidt"]).orderBy("doc_id").collect()
    assert [r.text for r in out] == [g[1] for g in GOLDEN]


def test_chain_equals_sequential_substitution(frame):
    texts = [g[0] for g in GOLDEN] + ["ü2020 2020ü x²2020 2020", "٠١٢ A١٢٣456789", "ë2020"]

    def expected(t):
        for name, pattern in SCRUB_RULES:
            t = re.sub(pattern, f"[{name}]", t)
        return t

    got = frame(*texts).select("doc_id", apply_rules("text").alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in got] == [expected(t) for t in texts]


ODD = "ä ² Ⅰ _x\u001cy z\u0085w 12٣ ß-Ä [q] c^d & é"


@pytest.mark.parametrize(
    "pattern", [r"\w+", r"\W", r"\d", r"\D+", r"\s", r"\S+", r"\b", r"[\w-]+", r"[^\s]", r"[^]a]", r"[[q]", r"x|[&&z]"]
)
def test_portable_regex_matches_like_unicode_patterns(frame, pattern):
    got = frame(ODD).select(F.regexp_replace("text", portable_regex(pattern), "<>")).first()[0]
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert got == re.sub(pattern, "<>", ODD)


def test_tokens_and_whitespace(frame):
    texts = [ODD, "", "  ", "\n\na\tb ", "x y　 z"]
    rows = frame(*texts).select("text", tokens("text").alias("t"), squash_ws("text").alias("s")).collect()
    for r in rows:
        assert r.t == r.text.split()
        assert r.s == " ".join(r.text.split())


def test_norm_token(frame):
    rows = frame("Müller,", "(Weber)", "a-b_c²", "...").select("text", norm_token("text").alias("n")).collect()
    assert [r.n for r in rows] == [re.sub(r"[^\w]", "", r.text) for r in rows]


def test_inline_and_join_agree(spark, frame):
    df = frame("Herr Weber, Frau (Weber) in Ulm/Berlin Berlin!", "Essen Berlin", "", "nichts")
    names, cities = ["Weber", "Berlin"], ["Berlin", "Essen"]
    a = scrub(df, names=names, cities=cities).orderBy("doc_id").collect()
    b = scrub(df, names=words_frame(spark, names), cities=words_frame(spark, cities), strategy="join").orderBy("doc_id").collect()
    assert [r.text for r in a] == [r.text for r in b]
    assert a[0].text == "Herr [PERSON] Frau [PERSON] in Ulm/Berlin [PERSON]"
    assert a[1].text == "[LOCATION] [PERSON]"


def test_salted_join_agrees(spark, frame, monkeypatch):
    from textveil.operators import dictionary

    df = frame("Weber a", "b Weber", "c", "Ulm Weber")
    want = mask_by_join(df, "text", ["Weber"], ["Ulm"]).orderBy("doc_id").collect()
    monkeypatch.setattr(dictionary, "MAX_BROADCAST_WORDS", 0)
    got = mask_by_join(df, "text", ["Weber"], ["Ulm"]).orderBy("doc_id").collect()
    assert want == got and got[3].text == "[LOCATION] [PERSON]"


def test_dictionary_rules(spark):
    raw = words_frame(spark, ['"Meier"', " Abt ", "Au", "Ey", "Bach", "Abt", "Von essen"])
    safe = words_frame(spark, ["Bach"])
    assert {r.word for r in clean_word_list(raw, "word", 3, safe).collect()} == {"Meier", "Abt", "Von essen"}
    assert held_words(["a", "b", "c"], most=2) is None


def test_a_list_is_held_whole_or_not_at_all(spark, frame, monkeypatch):
    from textveil.operators import dictionary
    from textveil.operators.classify import scrub_and_classify

    many = spark.range(30_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    assert held_words(many, most=20_000) is None
    assert len(held_words(many, most=30_000)) == 30_000
    repeated = words_frame(spark, ["a"] * 5 + ["b", "c"])
    assert held_words(repeated, most=2) is None and held_words(repeated, most=3) == ["a", "b", "c"]
    monkeypatch.setattr(dictionary, "MAX_BROADCAST_WORDS", 20_000)
    docs = frame("w1 x w15000 w29999", "y").withColumn("logits", F.array(F.lit(0.0), F.lit(1.0)))
    got = scrub_and_classify(docs, names=many).orderBy("doc_id").collect()
    assert [(r.scrubbed, r.label) for r in got] == [("[PERSON] x [PERSON] [PERSON]", "UNSAFE"), ("y", "UNSAFE")]


def test_no_long_digit_runs_left_and_idempotent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once = scrub(docs, names=["Weber"])
    assert once.where(F.col("text").rlike(r"(?U)\d{3,}")).count() == 0
    twice = scrub(once.withColumnRenamed("text", "first").withColumn("text", F.col("first")))
    assert twice.where(F.col("first") != F.col("text")).count() == 0


def test_own_rules_and_replacement_escapes(frame):
    got = frame("a1b22").select(apply_rules("text", [("$1\\x", r"\d+")]).alias("t")).first().t
    assert got == "a[$1\\x]b[$1\\x]"


def test_small_helpers(frame):
    row = frame("\"'Hallo'\"").select(
        strip_quotes("text").alias("q"),
        truncate_tokens(F.lit(" a  b\nc d"), 3).alias("t"),
        fill_template("{a}-{b}!", a=F.lit("{b}"), b=F.lit("x")).alias("f"),
    ).first()
    assert row == ("Hallo", "a b c", "{b}-x!")
    assert re.fullmatch(quote_literal("C++ (x) $1"), "C++ (x) $1")


@pytest.mark.parametrize("pattern", [r"[^\W\d_]+", r"[\W\d]+", r"[^\S ]+", r"[\S ]+", r"\Bn", r"[^\Sa]"])
def test_negated_escapes_inside_classes(spark, pattern):
    text = "über Ünal 12_ x² é z y ٣"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.regexp_replace("t", portable_regex(pattern), "#")).first()[0]
    assert got == re.sub(pattern, "#", text)
