"""Queries: sources, scrubbing, entity detection and anonymization."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.constants import ENTITY_LABELS, LEGEND_PLACEHOLDERS, PLACEHOLDER_GROUPS, SCRUB_RULES
from textveil.functions.spans import confident, label_of, replace_spans
from textveil.functions.text import mask_numbers, norm_token, squash_ws, tokens, words
from textveil.operators import anonymize as an
from textveil.operators import dictionary as dic
from textveil.operators import scrub as sc
from textveil.operators.classify import string_array
from textveil.plans import corpus as co
from textveil.plans.registry import query, spread, table
from textveil.sources.tables import export_rules, parse_requests, read_in_order, to_responses
from textveil.sources.words import parse_deny_list, read_safe_words
from textveil.sources.workspace import new_dir

WITH_PROBE = f"WITH {co.PROBE}"
WITH_ALL = f"WITH {co.PROBE}, {co.DICTIONARIES}"

# --- sources ----------------------------------------------------------------


@query("s1_name_dictionary", f"WITH {co.DICTIONARIES} SELECT word FROM names")
def s1(spark, sf):
    return co.names(spark, sf)


@query("s2_city_dictionary", f"WITH {co.DICTIONARIES} SELECT word FROM cities")
def s2(spark, sf):
    return co.cities(spark, sf)


@query(
    "s3_safe_words",
    f"""WITH {co.PROBE} SELECT DISTINCT line AS word FROM (
      SELECT regexp_replace(unnest(string_split(text, chr(10))), '^{co.WS}+|{co.WS}+$', '', 'g') AS line FROM probe)
      WHERE line <> '' AND line[1] <> '#'""",
)
def s3(spark, sf):
    path = new_dir(spark, "safe")
    co.probe(spark, sf).select("text").write.text(path)
    return read_safe_words(spark, path)


@query(
    "s4_deny_list_parse",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS term,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM conversations)
       SELECT conv_id, turn, ord::INTEGER AS ord, trim(term) AS term FROM l WHERE trim(term) <> ''""",
)
def s4(spark, sf):
    return parse_deny_list(table(spark, sf, "conversations"), "text", ("conv_id", "turn"))


@query("s11_export_sorted_names", f"WITH {co.DICTIONARIES} SELECT word, row_number() OVER (ORDER BY word) - 1 AS position FROM names")
def s11(spark, sf):
    """The exported list, read back line by line."""
    root = new_dir(spark, "export")
    export_rules(spark, co.names(spark, sf), co.cities(spark, sf), root)
    return read_in_order(spark, f"{root}/deny_names").select(F.col("value").alias("word"), "position")


@query(
    "s11_export_rules",
    f"""WITH {co.DICTIONARIES}, r(position, name, pattern) AS (VALUES {", ".join(f"({i}, {co.sql_list([n, p])})" for i, (n, p) in enumerate(SCRUB_RULES))})
    SELECT position::INTEGER AS position, name, pattern, (SELECT count(*) FROM cities) AS cities FROM r""",
)
def s11_rules(spark, sf):
    """The exported rules, from their JSON, next to the number of exported places."""
    root = new_dir(spark, "export")
    export_rules(spark, co.names(spark, sf), co.cities(spark, sf), root)
    lines = spark.read.text(f"{root}/pii_config", wholetext=True)
    rules = F.from_json("value", "regex_rules array<struct<name:string,pattern:string>>")["regex_rules"]
    places = spark.read.text(f"{root}/deny_cities").agg(F.count("*").alias("cities"))
    return lines.select(F.posexplode(rules).alias("position", "r")).select("position", "r.name", "r.pattern", F.lit(places.scalar()).alias("cities"))


@query(
    "s14_requests",
    """SELECT doc_id,
         CASE WHEN doc_id % 5 = 0 THEN 'malformed JSON' WHEN doc_id % 5 = 1 THEN 'text is required'
              WHEN doc_id % 5 = 2 THEN 'text is empty' END AS reject,
         CASE WHEN doc_id % 5 = 2 THEN '' WHEN doc_id % 5 > 2 THEN text END AS text
       FROM documents""",
)
def s14(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.col("doc_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit('{"text": "'), F.col("doc_id").cast("string")))
        .when(kind == 1, F.lit('{"entries": ["a"]}'))
        .when(kind == 2, F.lit('{"text": ""}'))
        .otherwise(F.to_json(F.struct("text")))
    )
    return parse_requests(docs.select("doc_id", body.alias("body"))).select("doc_id", "reject", "text")


@query(
    "s14_responses",
    f"""{WITH_PROBE}, m AS (SELECT doc_id, text, regexp_extract_all(text, '{co.ZIP_RE2}') AS z FROM probe)
    SELECT doc_id, {co.sql_replace('text', co.ZIP_RE2, '<PLZ>')} AS anonymized_text, length(text)::INTEGER AS original_length,
      len(z)::INTEGER AS items_changed, z[1] AS first_entity FROM m""",
)
def s14b(spark, sf):
    bodies = to_responses(an.anonymize(co.probe(spark, sf), recognizers=[an.ZIP])).select("doc_id", "body")
    shape = "anonymized_text string, original_length int, items_changed int, entities array<struct<entity_type:string,text:string,score:double>>"
    back = bodies.select("doc_id", F.from_json("body", shape).alias("r"))
    first = F.get("r.entities", F.lit(0))["text"]
    return back.select("doc_id", "r.anonymized_text", "r.original_length", "r.items_changed", first.alias("first_entity"))


# --- single rules -----------------------------------------------------------


def _rule(key: str, name: str) -> None:
    sql = f"{WITH_PROBE} SELECT doc_id, {co.sql_replace('text', co.RE2_RULES[name], f'[{name}]')} AS text FROM probe"

    @query(key, sql)
    def run(spark, sf):
        return co.probe(spark, sf).select("doc_id", sc.rule_replace("text", name).alias("text"))


for _key, _name in [
    ("p1_medical_id", "MEDICAL_ID"),
    ("p2_iban", "IBAN"),
    ("p3_phone", "PHONE"),
    ("p4_email", "EMAIL"),
    ("p5_date_year", "DATE_YEAR"),
    ("p6_street", "STREET"),
]:
    _rule(_key, _name)


@query("p7_rule_chain", f"{WITH_PROBE} SELECT doc_id, {co.sql_rules()} AS text FROM probe")
def p7(spark, sf):
    return co.probe(spark, sf).select("doc_id", sc.apply_rules("text").alias("text"))


@query(
    "p7_rule_chain_pages",
    f"SELECT page_id, {co.sql_rules('html')} AS html FROM pages",
)
def p7_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.apply_rules("html").alias("html"))


@query(
    "p8_tokens",
    f"""{WITH_PROBE}, s AS (SELECT doc_id, {co.sql_squash('text')} AS t FROM probe)
    SELECT doc_id, t AS text, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INTEGER AS n_tokens FROM s""",
)
def p8(spark, sf):
    return co.probe(spark, sf).select(
        "doc_id", squash_ws("text").alias("text"), F.size(tokens("text")).alias("n_tokens")
    )


@query(
    "p9_norm_token",
    f"""{WITH_PROBE}, t AS (SELECT unnest(string_split({co.sql_squash('text')}, ' ')) AS token FROM probe)
    SELECT {co.sql_norm('token')} AS norm, count(*) AS n FROM t WHERE token <> '' GROUP BY 1""",
)
def p9(spark, sf):
    # distinct tokens first: each is normalised once
    toks = co.probe(spark, sf).select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    return toks.groupBy(norm_token("token").alias("norm")).agg(F.sum("c").alias("n"))


def _sql_mask(source: str, cities: bool) -> str:
    city = f"WHEN list_contains(cs, {co.sql_norm('t')}) THEN '[LOCATION]'" if cities else ""
    return f"""array_to_string(list_transform(string_split({source}, ' '), lambda t:
      CASE WHEN list_contains(ns, {co.sql_norm('t')}) THEN '[PERSON]' {city} ELSE t END), ' ')"""


@query("p10_mask_names", f"{WITH_ALL} SELECT doc_id, {_sql_mask(co.sql_squash('text'), False)} AS text FROM probe, dict")
def p10(spark, sf):
    words = dic.held_words(co.names(spark, sf))
    return co.probe(spark, sf).select("doc_id", sc.mask_tokens("text", words, "[PERSON]").alias("text"))


_P11 = f"{WITH_ALL} SELECT doc_id, {_sql_mask(co.sql_squash('text'), True)} AS text FROM probe, dict"


@query("p11_mask_cities", _P11)
def p11(spark, sf):
    lists = dic.held_words(co.names(spark, sf)), dic.held_words(co.cities(spark, sf))
    masked = sc.mask_dictionaries("text", [(lists[0], "[PERSON]"), (lists[1], "[LOCATION]")])
    return co.probe(spark, sf).select("doc_id", masked.alias("text"))


@query(
    "p12_safe_words_excluded",
    f"""WITH {co.DICTIONARIES} SELECT DISTINCT w AS word FROM (SELECT trim(unnest([{co.sql_list(co.EXTRA_NAMES + co.SAFE_WORDS)}]), '"') AS w
        UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark)
        WHERE length(w) >= 3 AND w NOT IN (SELECT word FROM safe)""",
)
def p12(spark, sf):
    raw = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    both = raw.unionByName(dic.words_frame(spark, co.EXTRA_NAMES + co.SAFE_WORDS))
    return dic.clean_word_list(both, "word", 3, co.safe_words(spark))


@query("p13_mask_numbers", rf"{WITH_PROBE} SELECT doc_id, regexp_replace(text, '\p{{Nd}}{{3,}}', '[NUM]', 'g') AS text FROM probe")
def p13(spark, sf):
    return co.probe(spark, sf).select("doc_id", mask_numbers("text").alias("text"))


_P14 = rf"""{WITH_ALL}, r AS (SELECT doc_id, lang, {co.sql_rules()} AS text FROM probe),
m AS (SELECT doc_id, lang, {_sql_mask(co.sql_squash('text'), True)} AS text FROM r, dict),
z AS (SELECT doc_id, lang, regexp_replace(text, '\p{{Nd}}{{3,}}', '[NUM]', 'g') AS text FROM m)"""


@query("p14_scrub", f"{_P14} SELECT doc_id, text FROM z")
def p14(spark, sf):
    return sc.scrub(co.probe(spark, sf), names=co.names(spark, sf), cities=co.cities(spark, sf)).select("doc_id", "text")


@query("p15_scrub_by_join", f"{_P14} SELECT doc_id, text FROM z")
def p15(spark, sf):
    return sc.scrub(
        co.probe(spark, sf), names=co.names(spark, sf), cities=co.cities(spark, sf), strategy="join"
    ).select("doc_id", "text")


_SOME_ID = "CASE WHEN doc_id % 10 <> 0 THEN doc_id END AS doc_id"


def _some_ids(df):
    """Every tenth row without an id."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")))


@query("p15_null_keys", f"{_P14} SELECT {_SOME_ID}, text FROM z")
def p15_null(spark, sf):
    rows = _some_ids(co.probe(spark, sf))
    return sc.scrub(rows, names=co.names(spark, sf), cities=co.cities(spark, sf), strategy="join").select("doc_id", "text")


@query(
    "p14_placeholders_by_lang",
    rf"""{_P14}, e AS (SELECT lang, unnest(regexp_extract_all(text, '\[[A-Z_]+\]')) AS label FROM z)
    SELECT lang, label, count(*) AS n FROM e GROUP BY 1, 2""",
)
def p14_lang(spark, sf):
    scrubbed = sc.scrub(co.probe(spark, sf), names=co.names(spark, sf), cities=co.cities(spark, sf))
    return sc.placeholder_census(scrubbed, by=["lang"])


@query(
    "p16_dictionary_stats",
    f"""WITH {co.DICTIONARIES} SELECT 'names' AS dictionary, count(*) AS words FROM names
    UNION ALL SELECT 'cities', count(*) FROM cities UNION ALL SELECT 'safe_words', count(DISTINCT word) FROM safe""",
)
def p16(spark, sf):
    return dic.dictionary_stats(names=co.names(spark, sf), cities=co.cities(spark, sf), safe_words=co.safe_words(spark))


# --- entity spans -----------------------------------------------------------

_SPAN_COLS = 'doc_id, entity_type, start, "end", score, text'


def _recognizer(key: str, recognizers, *patterns) -> None:
    ctes = ",\n".join(co.sql_spans(f"x{i}", p, t, s) for i, (p, t, s) in enumerate(patterns))
    union = " UNION ALL ".join(f"SELECT {_SPAN_COLS} FROM x{i}" for i in range(len(patterns)))

    @query(key, f"{WITH_PROBE},\n{ctes}\n{union}")
    def run(spark, sf):
        found = an.detect(co.probe(spark, sf), recognizers=recognizers, min_score=0.0)
        return an.entities(found)


_recognizer("a1_zip_spans", [an.ZIP], (co.ZIP_RE2, "GERMAN_ZIP", 1.0))
_recognizer(
    "a2_title_spans",
    [an.Recognizer("PERSON", an.TITLES.patterns[:1], an.TITLES.needs)],
    (co.DR_RE2, "PERSON", 0.9),
)
_recognizer(
    "a3_salutation_spans",
    [an.Recognizer("PERSON", an.TITLES.patterns[1:], an.TITLES.needs)],
    (co.HERR_RE2, "PERSON", 0.85),
)
_recognizer("a4_multi_pattern_spans", [an.TITLES], (co.DR_RE2, "PERSON", 0.9), (co.HERR_RE2, "PERSON", 0.85))
_recognizer("a6_email_spans", [an.EMAIL], (co.RE2_RULES["EMAIL"], "EMAIL_ADDRESS", 1.0))
_recognizer("a7_phone_spans", [an.PHONE], (co.RE2_RULES["PHONE"], "PHONE_NUMBER", 0.4))
_recognizer("a8_date_spans", [an.DATE], (co.DATE_RE2, "DATE_TIME", 0.6))

_DENY = f"{WITH_PROBE},\n{co.sql_spans('x0', co.DENY_RE2, 'INTERNAL_SENSITIVE', 1.0)}\nSELECT {_SPAN_COLS} FROM x0"


@query("a5_deny_list_spans", _DENY)
def a5(spark, sf):
    found = an.detect(co.probe(spark, sf), deny_terms=co.DENY_TERMS, recognizers=[])
    return an.entities(found)


@query("a5_deny_list_spans_by_join", _DENY)
def a5_join(spark, sf):
    found = an.with_deny_spans(co.probe(spark, sf), "text", co.DENY_TERMS, out="spans", strategy="join")
    return an.entities(found)


@query("a5_null_keys", _DENY.replace(f"SELECT {_SPAN_COLS}", "SELECT " + _SPAN_COLS.replace("doc_id", _SOME_ID)))
def a5_null(spark, sf):
    return an.entities(an.with_deny_spans(_some_ids(co.probe(spark, sf)), "text", co.DENY_TERMS, out="spans"))


_GAZ = rf"""tok AS (SELECT doc_id, regexp_extract_all(text, '{co.IS_WORD}') AS m, regexp_split_to_array(text, '{co.IS_WORD}') AS g FROM probe),
pos AS (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM tok),
placed AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pos),
kind AS (
  SELECT *, 'PERSON' AS entity_type, w IN (SELECT word FROM names) AS hit FROM placed
  UNION ALL SELECT *, 'LOCATION', w IN (SELECT word FROM cities) FROM placed),
brk AS (
  SELECT *, CASE WHEN gap = ' ' AND lag(hit) OVER (PARTITION BY doc_id, entity_type ORDER BY i) THEN 0 ELSE 1 END AS b FROM kind),
isl AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, entity_type ORDER BY i) AS k FROM brk),
run AS (
  SELECT doc_id, entity_type, min(e - length(w))::INTEGER AS start, max(e)::INTEGER AS "end"
  FROM isl WHERE hit GROUP BY doc_id, entity_type, k),
gaz AS (
  SELECT r.doc_id, r.entity_type, r.start, r."end", 0.85::DOUBLE AS score,
         substring(p.text, r.start + 1, r."end" - r.start) AS text
  FROM run r JOIN probe p ON p.doc_id = r.doc_id)"""
_GAZETTEER = f"{WITH_ALL},\n{_GAZ}\nSELECT {_SPAN_COLS} FROM gaz"


def _gazetteers(spark, sf):
    return {"PERSON": co.names(spark, sf), "LOCATION": co.cities(spark, sf)}


@query("a9_gazetteer_spans", _GAZETTEER)
def a9(spark, sf):
    found = an.with_gazetteer_spans(co.probe(spark, sf), "text", _gazetteers(spark, sf), out="spans")
    return an.entities(found)


@query("a9_gazetteer_spans_by_join", _GAZETTEER)
def a9_join(spark, sf):
    found = an.with_gazetteer_spans(co.probe(spark, sf), "text", _gazetteers(spark, sf), out="spans", strategy="join")
    return an.entities(found)


@query("a9_null_keys", f"{WITH_ALL},\n{_GAZ}\nSELECT {_SPAN_COLS.replace('doc_id', _SOME_ID)} FROM gaz")
def a9_null(spark, sf):
    rows = _some_ids(co.probe(spark, sf))
    return an.entities(an.with_gazetteer_spans(rows, "text", _gazetteers(spark, sf), out="spans", strategy="join"))


# all longer words of the documents, and as many entries again that occur nowhere
_FILLERS = 100_000
_LONG_WORDS = f"""entries AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '{co.IS_WORD}')) AS word FROM documents),
listed AS (SELECT word FROM entries WHERE length(word) >= 7 UNION SELECT 'entry' || i || 'x' FROM range({_FILLERS}) t(i))"""
_TOKENS = f"""tok AS (SELECT doc_id, regexp_extract_all(text, '{co.IS_WORD}') AS m, regexp_split_to_array(text, '{co.IS_WORD}') AS g FROM probe),
pos AS (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM tok),
placed AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pos)"""


def _large_list(spark, sf):
    long = table(spark, sf, "documents").select(F.explode(F.array_distinct(words("text"))).alias("word")).where(F.length("word") >= 7)
    fillers = spark.range(_FILLERS).select(F.concat(F.lit("entry"), F.col("id").cast("string"), F.lit("x")).alias("word"))
    return long.unionByName(fillers).distinct()


@query(
    "a5_large_deny_list",
    f"""{WITH_PROBE}, {_LONG_WORDS}, {_TOKENS}
    SELECT doc_id, 'INTERNAL_SENSITIVE' AS entity_type, (e - length(w))::INTEGER AS start, e::INTEGER AS "end", 1.0::DOUBLE AS score, w AS text
    FROM placed WHERE w IN (SELECT word FROM listed)""",
)
def a5_large(spark, sf):
    """Over 100,000 entries, by the code that also takes three."""
    return an.entities(an.detect(co.probe(spark, sf), deny_terms=_large_list(spark, sf), recognizers=[]))


@query(
    "a9_large_gazetteer",
    f"""{WITH_PROBE}, {_LONG_WORDS}, {_TOKENS},
    brk AS (SELECT *, w IN (SELECT word FROM listed) AS hit FROM placed),
    isl AS (SELECT *, sum(CASE WHEN gap = ' ' AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
            FROM (SELECT *, lag(hit) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM brk)),
    run AS (SELECT doc_id, min(e - length(w))::INTEGER AS start, max(e)::INTEGER AS "end" FROM isl WHERE hit GROUP BY doc_id, k)
    SELECT r.doc_id, 'TERM' AS entity_type, r.start, r."end", 0.85::DOUBLE AS score, substring(p.text, r.start + 1, r."end" - r.start) AS text
    FROM run r JOIN probe p ON p.doc_id = r.doc_id""",
)
def a9_large(spark, sf):
    found = an.with_gazetteer_spans(co.probe(spark, sf), "text", {"TERM": _large_list(spark, sf)}, out="spans")
    return an.entities(found)


_PHRASES = ["Nordlicht Labor", "Klinik am See"]
_PHRASE_SPANS = f"""{WITH_PROBE},
{co.sql_spans('x0', rf"\b(?:{'|'.join(_PHRASES)})\b", 'ORGANIZATION', 0.85)}
SELECT {_SPAN_COLS} FROM x0"""


def _phrases(key: str, strategy: str) -> None:
    @query(key, _PHRASE_SPANS)
    def run(spark, sf):
        return an.entities(an.with_gazetteer_spans(co.probe(spark, sf), "text", {"ORGANIZATION": _PHRASES}, out="spans", strategy=strategy))


_phrases("a9_phrase_gazetteer", "auto")
_phrases("a9_phrase_gazetteer_by_join", "join")


@query(
    "a10_external_spans",
    f"""{WITH_PROBE} SELECT doc_id, 'ORG' AS entity_type, 0::INTEGER AS start, least(length(text), 3 + doc_id % 4)::INTEGER AS "end",
        0.7::DOUBLE AS score, text[1:least(length(text), 3 + doc_id % 4)] AS text FROM probe WHERE length(text) >= 3 + doc_id % 4""",
)
def a10(spark, sf):
    docs = co.probe(spark, sf)
    # what a model run would have written, with repeats at a lower score
    end = (F.lit(3) + F.col("doc_id") % 4).cast("int")
    run = docs.select(
        "doc_id", F.lit("ORG").alias("entity_type"), F.lit(0).alias("start"), end.alias("end"),
        F.explode(F.array(F.lit(0.7), F.lit(0.5))).alias("score"),
    )
    return an.entities(an.detect(docs, recognizers=[], external=run))


@query(
    "a11_score_threshold",
    f"""{WITH_PROBE}, {co.sql_spans('x0', co.RE2_RULES['PHONE'], 'PHONE_NUMBER', 0.4)},
    {co.sql_spans('x1', co.DATE_RE2, 'DATE_TIME', 0.39)}
    SELECT doc_id, count(*)::INTEGER AS n FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1) WHERE score >= 0.4 GROUP BY 1""",
)
def a11(spark, sf):
    low_date = an.Recognizer("DATE_TIME", (("date", an.DATE_PATTERN, 0.39),), an.DATE.needs)
    found = an.detect(co.probe(spark, sf), recognizers=[an.PHONE, low_date], min_score=0.0)
    kept = found.select("doc_id", F.size(confident("spans", 0.4)).alias("n"))
    return kept.where("n > 0")


_TYPES = [*ENTITY_LABELS, "CREDIT_CARD"]


@query(
    "a12_placeholder_of_type",
    f"""WITH m AS (SELECT unnest([{co.sql_list(ENTITY_LABELS)}]) AS t, unnest([{co.sql_list(ENTITY_LABELS.values())}]) AS l),
    d AS (SELECT doc_id, ([{co.sql_list(_TYPES)}])[doc_id % {len(_TYPES)} + 1] AS entity_type FROM documents)
    SELECT doc_id, entity_type, coalesce(l, '<DATEN>') AS label FROM d LEFT JOIN m ON t = entity_type""",
)
def a12(spark, sf):
    kind = F.get(string_array(_TYPES), F.pmod("doc_id", F.lit(len(_TYPES))).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", kind.alias("entity_type"))
    return docs.withColumn("label", label_of("entity_type"))


# All detections, ranked per document; in each round the spans without a better
# overlapping one are kept and everything they overlap is dropped.
_ROUNDS = 5
_ALL_FINDERS = [
    (co.ZIP_RE2, "GERMAN_ZIP", 1.0),
    (co.DR_RE2, "PERSON", 0.9),
    (co.HERR_RE2, "PERSON", 0.85),
    (co.RE2_RULES["EMAIL"], "EMAIL_ADDRESS", 1.0),
    (co.RE2_RULES["PHONE"], "PHONE_NUMBER", 0.4),
    (co.DATE_RE2, "DATE_TIME", 0.6),
    (co.DENY_RE2, "INTERNAL_SENSITIVE", 1.0),
]


def _resolved() -> str:
    finders = [co.sql_spans(f"f{i}", p, t, s) for i, (p, t, s) in enumerate(_ALL_FINDERS)]
    union = " UNION ALL ".join(f"SELECT {_SPAN_COLS} FROM {c}" for c in [*[f"f{i}" for i in range(len(finders))], "gaz"])
    ctes = [co.PROBE, co.DICTIONARIES, _GAZ, *finders]
    ctes.append(
        f"""s0 AS (SELECT *, row_number() OVER (
          PARTITION BY doc_id ORDER BY score DESC, "end" - start DESC, start, entity_type) AS pr FROM ({union}))"""
    )
    overlap = 'b.doc_id = a.doc_id AND b.start < a."end" AND a.start < b."end"'
    for i in range(_ROUNDS):
        ctes.append(f"k{i} AS (SELECT a.* FROM s{i} a WHERE NOT EXISTS (SELECT 1 FROM s{i} b WHERE {overlap} AND b.pr < a.pr))")
        ctes.append(f"s{i + 1} AS (SELECT a.* FROM s{i} a WHERE NOT EXISTS (SELECT 1 FROM k{i} b WHERE {overlap}))")
    ctes.append("kept AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(_ROUNDS)) + ")")
    return "WITH " + ",\n".join(ctes)


@query("a13_resolved_spans", f"{_resolved()}\nSELECT {_SPAN_COLS} FROM kept")
def a13(spark, sf):
    found = an.detect(co.probe(spark, sf), deny_terms=co.DENY_TERMS, gazetteers=_gazetteers(spark, sf))
    return an.entities(an.resolved(found))


@query(
    "a13_long_cluster",
    rf"""{WITH_PROBE}, w AS (SELECT doc_id, regexp_extract_all(text, '{co.IS_WORD}') AS m, regexp_split_to_array(text, '{co.IS_WORD}') AS g FROM probe),
    p AS (SELECT doc_id, unnest(g[1:len(m)]) AS gap, unnest(m) AS word, unnest(range(1, len(m) + 1)) AS i FROM w),
    s AS (SELECT doc_id, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS start FROM p),
    n AS (SELECT doc_id, count(*) AS n, sum(start) AS starts FROM s GROUP BY 1)
    SELECT doc_id, (coalesce(n, 0) + CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::INTEGER AS found, coalesce(n, CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::INTEGER AS kept,
      coalesce(starts, 0)::BIGINT AS starts FROM probe LEFT JOIN n USING (doc_id)""",
)
def a13_long(spark, sf):
    """Every word is a span inside one that covers the whole text: one cluster a document."""
    both = [an.Recognizer("ALL", (("all", r"[\s\S]+", 0.5),)), an.Recognizer("WORD", (("word", r"\w+", 0.9),))]
    found = an.detect(co.probe(spark, sf), recognizers=both).withColumn("found", F.size("spans"))
    kept = an.resolved(found)
    starts = F.aggregate(F.transform("spans", lambda s: s.start.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return kept.select("doc_id", "found", F.size("spans").alias("kept"), starts.alias("starts"))


@query("a14_replace_spans", f"{WITH_PROBE} SELECT doc_id, {co.sql_replace('text', co.ZIP_RE2, '<PLZ>')} AS text FROM probe")
def a14(spark, sf):
    found = an.detect(co.probe(spark, sf), recognizers=[an.ZIP])
    return found.select("doc_id", replace_spans("text", "spans").alias("text"))


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in ENTITY_LABELS.items())


@query(
    "a15_anonymize",
    f"""{_resolved()},
lab(entity_type, label) AS (VALUES {_LABELS}),
step AS (
  SELECT k.doc_id, k.start, k."end", l.label,
         coalesce(lag(k."end") OVER (PARTITION BY k.doc_id ORDER BY k.start), 0) AS before
  FROM kept k JOIN lab l ON l.entity_type = k.entity_type),
glued AS (
  SELECT p.doc_id, string_agg(substring(p.text, s.before + 1, s.start - s.before) || s.label, '' ORDER BY s.start) AS head,
         max(s."end") AS done
  FROM step s JOIN probe p ON p.doc_id = s.doc_id GROUP BY 1),
num AS (SELECT doc_id, count(*) AS n FROM s0 GROUP BY 1)
SELECT p.doc_id, coalesce(g.head, '') || substring(p.text, coalesce(g.done, 0) + 1) AS anonymized_text,
       length(p.text)::INTEGER AS original_length, coalesce(num.n, 0)::INTEGER AS items_changed
FROM probe p LEFT JOIN glued g ON g.doc_id = p.doc_id LEFT JOIN num ON num.doc_id = p.doc_id""",
)
def a15(spark, sf):
    done = an.anonymize(co.probe(spark, sf), deny_terms=co.DENY_TERMS, gazetteers=_gazetteers(spark, sf))
    return done.select("doc_id", "result.anonymized_text", "result.original_length", "result.items_changed")


@query(
    "a15_anonymize_disjoint",
    f"""{WITH_PROBE}, {co.sql_spans('x0', co.ZIP_RE2, 'GERMAN_ZIP', 1.0)}, {co.sql_spans('x1', co.RE2_RULES['EMAIL'], 'EMAIL_ADDRESS', 1.0)},
    {co.sql_spans('x2', co.DENY_RE2, 'INTERNAL_SENSITIVE', 1.0)}, {co.sql_spans('x3', co.DR_RE2, 'PERSON', 0.9)}, {co.sql_spans('x4', co.HERR_RE2, 'PERSON', 0.85)},
    n AS (SELECT doc_id, count(*) AS c FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3 UNION ALL SELECT * FROM x4) GROUP BY 1)
    SELECT p.doc_id, {co.sql_replace(co.sql_replace(co.sql_replace(co.sql_replace(co.sql_replace('text', co.RE2_RULES['EMAIL'], '<EMAIL>'), co.ZIP_RE2, '<PLZ>'), co.DENY_RE2, '<INTERN>'), co.DR_RE2, '<PERSON>'), co.HERR_RE2, '<PERSON>')} AS anonymized_text,
      length(text)::INTEGER AS original_length, coalesce(c, 0)::INTEGER AS items_changed
    FROM probe p LEFT JOIN n ON n.doc_id = p.doc_id""",
)
def a15_disjoint(spark, sf):
    done = an.anonymize(co.probe(spark, sf), deny_terms=co.DENY_TERMS, recognizers=[an.ZIP, an.TITLES, an.EMAIL])
    return done.select("doc_id", "result.anonymized_text", "result.original_length", "result.items_changed")


@query(
    "a15_many_matches",
    f"""WITH {co.PROBE.replace("text || ' ' ||", "text || ' ' || repeat(' ' ||").replace("+ 1] AS text", "+ 1], 600) AS text")}
    SELECT doc_id, {co.sql_replace(co.sql_replace('text', co.RE2_RULES['EMAIL'], '<EMAIL>'), co.ZIP_RE2, '<PLZ>')} AS anonymized_text,
      length(text)::INTEGER AS original_length,
      (len(regexp_extract_all(text, '{co.RE2_RULES['EMAIL']}')) + len(regexp_extract_all(text, '{co.ZIP_RE2}')))::INTEGER AS items_changed
    FROM probe""",
)
def a15_many(spark, sf):
    """Texts with hundreds of matches each: more than one block of spans."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    suffix = F.get(string_array(co.SUFFIXES), F.pmod("doc_id", F.lit(len(co.SUFFIXES))).cast("int"))
    longer = docs.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.concat(F.lit(" "), suffix), F.lit(600))))
    done = an.anonymize(longer, recognizers=[an.ZIP, an.EMAIL])
    return done.select("doc_id", "result.anonymized_text", "result.original_length", "result.items_changed")


_BLANKED = "blanked AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents)"


@query(
    "a16_empty_text",
    f"""WITH {_BLANKED} SELECT doc_id, {co.sql_replace('text', co.ZIP_RE2, '<PLZ>')} AS anonymized_text,
        length(text)::INTEGER AS original_length, len(regexp_extract_all(text, '{co.ZIP_RE2}'))::INTEGER AS items_changed
    FROM blanked""",
)
def a16(spark, sf):
    docs = table(spark, sf, "documents")
    blanked = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("text")))
    done = an.anonymize(blanked, recognizers=[an.ZIP])
    return done.select("doc_id", "result.anonymized_text", "result.original_length", "result.items_changed")


_FOUND = "found AS (" + " UNION ALL ".join(
    f"SELECT doc_id, source, '{t}' AS entity_type, {s}::DOUBLE AS score, unnest(regexp_extract_all(text, '{p}')) AS text FROM probe"
    for p, t, s in _ALL_FINDERS
) + ")"


@query(
    "a17_items_changed",
    f"""{WITH_PROBE}, {_FOUND} SELECT p.doc_id, count(f.entity_type)::INTEGER AS items_changed
        FROM probe p LEFT JOIN found f ON f.doc_id = p.doc_id GROUP BY 1""",
)
def a17(spark, sf):
    found = an.detect(co.probe(spark, sf), deny_terms=co.DENY_TERMS)
    return found.select("doc_id", F.size("spans").alias("items_changed"))


@query("a18_original_length", f"{WITH_PROBE} SELECT doc_id, length(text || ' 😀')::INTEGER AS original_length FROM probe")
def a18(spark, sf):
    longer = co.probe(spark, sf).withColumn("text", F.concat("text", F.lit(" 😀")))
    return an.anonymize(longer).select("doc_id", "result.original_length")


@query("a19_entities", f"{WITH_PROBE}, {_FOUND} SELECT doc_id, entity_type, text, score FROM found")
def a19(spark, sf):
    found = an.detect(co.probe(spark, sf), deny_terms=co.DENY_TERMS)
    return an.entities(found).select("doc_id", "entity_type", "text", "score")


@query("a20_audit_by_type", f"{WITH_PROBE}, {_FOUND} SELECT entity_type, count(*) AS n FROM found GROUP BY 1")
def a20(spark, sf):
    return an.count_by_type(co.probe(spark, sf), deny_terms=co.DENY_TERMS)


@query("a20_audit_by_document", f"{WITH_PROBE}, {_FOUND} SELECT doc_id, entity_type, count(*) AS n FROM found GROUP BY 1, 2")
def a20_doc(spark, sf):
    return an.count_by_type(co.probe(spark, sf), ["doc_id"], deny_terms=co.DENY_TERMS)


@query("a20_audit_rollup", f"{WITH_PROBE}, {_FOUND} SELECT source, entity_type, count(*) AS n FROM found GROUP BY ROLLUP (source, entity_type)")
def a20_rollup(spark, sf):
    return an.count_by_type(co.probe(spark, sf), ["source"], rollup=True, deny_terms=co.DENY_TERMS)


@query(
    "a21_deny_list_reload",
    rf"""{WITH_PROBE}, m AS (
      SELECT 1 AS version, unnest(regexp_extract_all(text, '\bNordlicht\b')) AS t FROM probe
      UNION ALL SELECT 2, unnest(regexp_extract_all(text, '\b(?:Klinik am See|Hauptstraße)')) FROM probe)
    SELECT version::INTEGER AS version, t AS term, count(*) AS n FROM m GROUP BY 1, 2""",
)
def a21(spark, sf):
    docs = co.probe(spark, sf)
    active = an.DenyList(spark, entries=["Nordlicht"])
    before = an.detect(docs, deny_terms=active.entries, recognizers=[])
    active.reload(["Klinik am See", "Hauptstraße"])
    after = an.detect(docs, deny_terms=active.entries, recognizers=[])
    parts = [
        an.entities(found).select(F.lit(v).alias("version"), F.col("text").alias("term"))
        for v, found in ((1, before), (2, after))
    ]
    return parts[0].unionByName(parts[1]).groupBy("version", "term").agg(F.count("*").alias("n"))


_GROUPS = ", ".join(f"('{k}', '{v}')" for k, v in PLACEHOLDER_GROUPS.items())
_CENSUS = f"""{WITH_PROBE}, o AS (SELECT {co.sql_replace(co.sql_replace('text', co.RE2_RULES['EMAIL'], '<EMAIL>'), co.DATE_RE2, '<DATUM>')} AS t FROM probe),
p AS (SELECT unnest(regexp_extract_all(t, '<[A-Z]+>')) AS placeholder FROM o),
g(placeholder, display_group) AS (VALUES {_GROUPS})
SELECT p.placeholder, g.display_group, count(*) AS n FROM p JOIN g ON g.placeholder = p.placeholder"""


@query("a22_placeholder_census", f"{_CENSUS} GROUP BY 1, 2")
def a22(spark, sf):
    done = an.anonymize(co.probe(spark, sf), recognizers=[an.EMAIL, an.DATE])
    return an.placeholder_counts(done, "result.anonymized_text")


@query("a22_placeholder_legend", f"{_CENSUS} WHERE p.placeholder IN ({co.sql_list(LEGEND_PLACEHOLDERS)}) GROUP BY 1, 2")
def a22_legend(spark, sf):
    done = an.anonymize(co.probe(spark, sf), recognizers=[an.EMAIL, an.DATE])
    return an.placeholder_counts(done, "result.anonymized_text", legend_only=True)
