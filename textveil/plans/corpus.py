"""Input tables of the queries and the SQL that builds the same ones.

The given documents hold no German personal data, so every document gets a
fixed German suffix chosen by its id: the *probe corpus*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textveil.operators.classify import string_array
from textveil.operators.dictionary import clean_word_list, words_frame
from textveil.plans.registry import spread, table

SUFFIXES = [
    "Ich heiße Peter Müller und wohne in 12345 Berlin.",
    "Mein Arzt ist Dr. Müller in der Klinik am See.",
    "Herr Weber, Hauptstraße 12a",
    "KV A123456789, IBAN DE89 3704 0044 0532 0130 00",
    "Ruf an: 0176 12345678 oder peter@example.com",
    "seit 1998 bei Nordlicht Labor, frag Nordlicht",
    "",
    "Frau Schmidt am 01.02.2020, Tel +49 30 1234567",
]
DENY_TERMS = ["Nordlicht Labor", "Nordlicht Praxis", "Nordlicht"]
EXTRA_NAMES = ["Peter", "Müller", "Weber", "Schmidt", '"Meier"', "Essen"]
SAFE_WORDS = ["Essen", "Trier", "Haus", "Abend", "This", "When"]
EXTRA_CITIES = ["Berlin", "Ulm", "Trier", "Hamburg"]


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def probe(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    columns = ["doc_id", "lang", "source", "text", *extra]
    docs = spread(table(spark, sf_dir, "documents").select(*columns), "doc_id")
    suffix = F.get(string_array(SUFFIXES), F.pmod("doc_id", F.lit(len(SUFFIXES))).cast("int"))
    return docs.withColumn("text", F.concat_ws(" ", "text", suffix))


PROBE = f"""probe AS (
  SELECT doc_id, lang, source,
         text || ' ' || ([{sql_list(SUFFIXES)}])[doc_id % {len(SUFFIXES)} + 1] AS text
  FROM documents)"""

# whitespace and word classes for RE2
WS = r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
IS_WORD = r"[\p{L}\p{N}_]+"

# the structured patterns for RE2
RE2_RULES = {
    "MEDICAL_ID": r"\b[A-Z]\p{Nd}{9}\b",
    "IBAN": rf"\bDE\p{{Nd}}{{2}}{WS}?(?:\p{{Nd}}{{4}}{WS}?){{4}}\p{{Nd}}{{2}}\b",
    "PHONE": rf"(?:\+49|0)(?:{WS}*\p{{Nd}}+){{1,4}}(?:[-/]|{WS})*\p{{Nd}}{{3,}}",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "DATE_YEAR": r"\b(?:19|20)\p{Nd}{2}\b",
    "STREET": r"\b[A-ZÄÖÜ][a-zäöüß]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)"
    + rf"{WS}*\p{{Nd}}+[a-zA-Z]?\b",
}


def sql_replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"


def sql_rules(expr: str = "text") -> str:
    for name, pattern in RE2_RULES.items():
        expr = sql_replace(expr, pattern, f"[{name}]")
    return expr


def sql_squash(expr: str) -> str:
    return f"trim({sql_replace(expr, WS + '+', ' ')})"


def sql_norm(expr: str) -> str:
    return sql_replace(expr, NOT_WORD, "")


# --- dictionaries -----------------------------------------------------------

def safe_words(spark: SparkSession) -> DataFrame:
    return words_frame(spark, SAFE_WORDS)


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of the benchmark passages and a few names."""
    items = table(spark, sf_dir, "benchmark")
    found = items.select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[A-Z][a-z]*$"))
    return found.unionByName(words_frame(spark, EXTRA_NAMES))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_word_list(raw_names(spark, sf_dir), "word", 3, safe_words(spark))


def raw_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("word"))
    return nations.unionByName(words_frame(spark, EXTRA_CITIES))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_word_list(raw_cities(spark, sf_dir), "word", 4, safe_words(spark))


DICTIONARIES = f"""safe AS (SELECT unnest([{sql_list(SAFE_WORDS)}]) AS word),
names AS (
  SELECT DISTINCT word FROM (
    SELECT trim(trim(w), '"') AS word
    FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Z][a-z]*$')
    UNION ALL SELECT trim(unnest([{sql_list(EXTRA_NAMES)}]), '"'))
  WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM safe)),
cities AS (
  SELECT DISTINCT word FROM (
    SELECT upper(n_name[1]) || lower(n_name[2:]) AS word FROM nation
    UNION ALL SELECT unnest([{sql_list(EXTRA_CITIES)}]))
  WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM safe)),
dict AS (SELECT (SELECT list(word) FROM names) AS ns, (SELECT list(word) FROM cities) AS cs)"""


# --- spans in SQL -----------------------------------------------------------

def sql_spans(cte: str, pattern: str, entity_type: str, score: float, source: str = "probe") -> str:
    """CTEs that end in ``cte(doc_id, entity_type, start, "end", score, text)``.

    The start of a match is the length of everything before it: the gaps up to
    it and the earlier matches.
    """
    return f"""{cte}_m AS (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m,
         regexp_split_to_array(text, '{pattern}') AS g FROM {source}),
{cte}_i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {cte}_m),
{cte}_s AS (
  SELECT doc_id, m[i] AS text,
         (list_sum(list_transform(g[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS s
  FROM {cte}_i),
{cte} AS (
  SELECT doc_id, '{entity_type}' AS entity_type, s AS start, (s + length(text))::INTEGER AS "end",
         {score}::DOUBLE AS score, text FROM {cte}_s)"""


ZIP_RE2 = r"\b\p{Nd}{5}\b"
DR_RE2 = rf"\b(?:Dr\.|Prof\.){WS}+[A-ZÄÖÜ][a-zäöüß]+"
HERR_RE2 = rf"\b(?:Herr|Frau){WS}+[A-ZÄÖÜ][a-zäöüß]+"
DATE_RE2 = r"\b(?:\p{Nd}{1,2}\.\p{Nd}{1,2}\.\p{Nd}{4}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|(?:19|20)\p{Nd}{2})\b"
DENY_RE2 = r"\b(?:Nordlicht Praxis|Nordlicht Labor|Nordlicht)\b"


# --- logits every engine can compute ----------------------------------------

def logits(n: int, seed: int = 7) -> Column:
    cells = [
        F.pmod(F.col("n_chars") * (j + 3) + F.col("doc_id") * seed, F.lit(41)).cast("double") / 10.0 - 2.0
        for j in range(n)
    ]
    return F.array(*cells)


def sql_logit(j: str, seed: int = 7) -> str:
    return f"(((n_chars * ({j} + 3) + doc_id * {seed}) % 41)::DOUBLE / 10.0 - 2.0)"


def classified_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every tenth one blank."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def sql_long(labels, seed: int = 7) -> str:
    """CTEs ``long(doc_id, blank, j, label, x)``: one row per text and label."""
    return f"""lab AS (
  SELECT unnest(range(0, {len(labels)})) AS j, unnest([{sql_list(labels)}]) AS label),
long AS (
  SELECT doc_id, doc_id % 10 = 0 AS blank, j, label, {sql_logit('j', seed)} AS x FROM documents CROSS JOIN lab)"""


# --- scored truth -----------------------------------------------------------

def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("int").alias("y_true"),
    )


SCORED_EVENTS = """scored AS (
  SELECT event_id AS id, value AS score, (event_type = 'error')::INTEGER AS y_true FROM events)"""


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("category"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y_true"))
    score = F.pmod(F.col("doc_id") * 7919, F.lit(1000)).cast("double") / 1000.0
    return docs.join(labels, "doc_id").withColumn("score", score)


SCORED_DOCS = """scored AS (
  SELECT d.doc_id, d.text, d.source AS category, l.toxic AS y_true,
         ((d.doc_id * 7919) % 1000)::DOUBLE / 1000.0 AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

COUNTS = """per AS (
  SELECT score AS threshold, sum(y_true)::BIGINT AS pos, sum(1 - y_true)::BIGINT AS neg FROM scored GROUP BY 1),
c AS (
  SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM per WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""
