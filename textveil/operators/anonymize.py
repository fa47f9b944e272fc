"""Entity detection and replacement with placeholders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textveil.constants import (
    DATE_PATTERN,
    DATE_SCORE,
    DENY_SCORE,
    EMAIL_SCORE,
    GAZETTEER_SCORE,
    LEGEND_PLACEHOLDERS,
    MIN_SPAN_SCORE,
    PHONE_SCORE,
    PLACEHOLDER_GROUPS,
    SCRUB_RULES,
    TITLE_PATTERNS,
    ZIP_PATTERN,
    ZIP_SCORE,
)
from textveil.functions.spans import (
    SPAN_DDL,
    confident,
    contains_any,
    hit_spans,
    in_text_order,
    no_spans,
    pattern_spans,
    replace_spans,
    resolve_overlaps,
    term_spans,
)
from textveil.functions.arrays import settled, unpack
from textveil.functions.lookup import Terms, find_terms, find_terms_as_of
from textveil.functions.regex import portable_regex
from textveil.functions.text import as_col
from textveil.operators.dictionary import held_lists, held_words, with_terms

_DIGIT = r"\p{Nd}"


@dataclass(frozen=True)
class Recognizer:
    """One entity type found by several patterns, each with its own score.

    ``patterns`` holds ``(name, pattern, score)``; ``needs`` is an optional
    cheap condition that holds for every text with a match.
    """

    entity_type: str
    patterns: Sequence[tuple[str, str, float]] = field(default_factory=tuple)
    needs: str | tuple[str, ...] | None = None

    def spans(self, txt) -> Column:
        return recognized_spans(txt, [self])


def recognized_spans(txt, recognizers: Sequence[Recognizer]) -> Column:
    """Spans of all recognizers; those with the same ``needs`` share its check."""
    groups: dict = {}
    for r in recognizers:
        found = [pattern_spans(txt, p, r.entity_type, s) for _, p, s in r.patterns]
        groups.setdefault(r.needs, []).extend(found)
    parts = []
    for needs, found in groups.items():
        both = F.concat(no_spans(), *found)
        parts.append(F.when(contains_any(txt, needs), both).otherwise(no_spans()) if needs else both)
    return F.concat(no_spans(), *parts)


ZIP = Recognizer("GERMAN_ZIP", (("zip", ZIP_PATTERN, ZIP_SCORE),), _DIGIT)
TITLES = Recognizer("PERSON", tuple(TITLE_PATTERNS), ("Dr.", "Prof.", "Herr", "Frau"))
EMAIL = Recognizer("EMAIL_ADDRESS", (("email", dict(SCRUB_RULES)["EMAIL"], EMAIL_SCORE),), ("@",))
PHONE = Recognizer("PHONE_NUMBER", (("phone", dict(SCRUB_RULES)["PHONE"], PHONE_SCORE),), _DIGIT)
DATE = Recognizer("DATE_TIME", (("date", DATE_PATTERN, DATE_SCORE),), _DIGIT)
DEFAULT_RECOGNIZERS = (ZIP, TITLES, EMAIL, PHONE, DATE)


def deny_list_spans(txt, terms: Sequence[str]) -> Column:
    """Spans of deny-list terms; no terms, no spans."""
    return term_spans(txt, list(terms), "INTERNAL_SENSITIVE", DENY_SCORE)


def with_deny_spans(df: DataFrame, txt: str, terms, out: str = "deny_spans", strategy: str = "auto") -> DataFrame:
    """Deny-list spans for lists of any size (see :func:`with_term_spans`)."""
    return with_term_spans(df, txt, [("INTERNAL_SENSITIVE", terms, DENY_SCORE, False)], out, strategy)


def with_gazetteer_spans(
    df: DataFrame,
    txt: str,
    dictionaries: dict[str, object],
    score: float = GAZETTEER_SCORE,
    out: str = "gazetteer_spans",
    strategy: str = "auto",
) -> DataFrame:
    """Spans of dictionary entries per entity type.

    ``dictionaries`` maps an entity type to a list or frame of words or phrases.  Hits
    of one type with only a space between them form one span.
    """
    kinds = [(t, listed, score, True) for t, listed in dictionaries.items()]
    return with_term_spans(df, txt, kinds, out, strategy)


def with_term_spans(df: DataFrame, txt: str, kinds: Sequence[tuple], out: str, strategy: str = "auto", most: int | None = None) -> DataFrame:
    """Spans of the entries of ``(entity type, list or frame, score, merge)`` kinds.

    Entries of any number of words, or none, are found by one automaton.  Lists
    beyond what executors can hold (with the strategy ``join`` all lists) are first
    cut down to entries whose first words occur; where even these are too many, each
    row's own few entries make a pattern for that row.
    """
    found = held_lists(df, F.col(txt), [k[1] for k in kinds], strategy, by_anchor=True, most=most)
    if found is not None:
        listed = [Terms(k[0], terms, k[2], k[3]) for k, terms in zip(kinds, found) if terms]
        return df.withColumn(out, find_terms(txt, listed) if listed else no_spans())
    ready = with_terms(df, txt, {str(i): k[1] for i, k in enumerate(kinds)})
    spans = [hit_spans(txt, f"_hits_{i}", k[0], k[2], merge=k[3]) for i, k in enumerate(kinds)]
    return ready.withColumn(out, F.concat(no_spans(), *spans)).drop(*[f"_hits_{i}" for i in range(len(kinds))])


def with_deny_spans_as_of(df: DataFrame, txt: str, ts: str, versions: DataFrame, out: str = "deny_spans") -> DataFrame:
    """Deny-list spans by the version of the list in force at each row's event time.

    ``versions`` has ``valid_from`` and ``term``, all terms of a version with its time;
    a version ends where the next one begins.  A late row meets the version of its
    own time, not the newest.  All versions together are sent to the executors, so
    their counted size is bounded.
    """
    listed = versions.select(F.unix_micros(F.col("valid_from").cast("timestamp")).alias("since"), F.col("term").alias("word"))
    if held_words(listed) is None:
        raise ValueError("the versions of the list are too large for the executors' memory")
    terms: dict[int, list[str]] = {}
    for r in listed.distinct().collect():
        terms.setdefault(r["since"], []).append(r["word"])
    kinds = [(since, Terms("INTERNAL_SENSITIVE", [w for w in ws if w], DENY_SCORE)) for since, ws in terms.items()]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn(out, find_terms_as_of(txt, micros, kinds) if kinds else no_spans())


def with_external_spans(df: DataFrame, spans_df: DataFrame, txt: str = "text", key: str = "doc_id", out: str = "external_spans") -> DataFrame:
    """Spans written by a model run, ``(key, entity_type, start, end, score)``.

    Repeated spans are merged before anything is gathered, so a row receives at
    most the distinct spans of its own text; spans outside of it are dropped.
    """
    unique = spans_df.groupBy(key, "entity_type", "start", "end").agg(F.max("score").alias("score"))
    gathered = unique.groupBy(key).agg(
        F.collect_list(F.struct("entity_type", "start", "end", "score")).alias("_found")
    )
    c = as_col(txt)
    valid = F.filter("_found", lambda s: (s.start >= 0) & (s.start < s.end) & (s.end <= F.length(c)))
    spans = F.transform(
        valid,
        lambda s: F.struct(
            s.entity_type.alias("entity_type"),
            s.start.cast("int").alias("start"),
            s.end.cast("int").alias("end"),
            s.score.cast("double").alias("score"),
            F.substring(c, s.start.cast("int") + 1, (s.end - s.start).cast("int")).alias("text"),
        ),
    ).cast(f"array<{SPAN_DDL}>")
    return df.join(gathered, key, "left").withColumn(out, F.coalesce(spans, no_spans())).drop("_found")


def detect(
    df: DataFrame,
    txt: str = "text",
    deny_terms=(),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    gazetteers: dict[str, object] | None = None,
    external: DataFrame | None = None,
    min_score: float = MIN_SPAN_SCORE,
    key: str = "doc_id",
    out: str = "spans",
    deny_as_of: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """Add the array of detected spans at or above ``min_score``.

    ``deny_as_of`` is an event-time column and the versions of a deny list (see
    :func:`with_deny_spans_as_of`).
    """
    parts, ready, extra = [recognized_spans(txt, recognizers)], df, []
    if isinstance(deny_terms, DataFrame) or deny_terms:
        ready, extra = with_deny_spans(ready, txt, deny_terms, "_deny"), extra + ["_deny"]
        parts.append(F.col("_deny"))
    if deny_as_of is not None:
        ready, extra = with_deny_spans_as_of(ready, txt, *deny_as_of, "_asof"), extra + ["_asof"]
        parts.append(F.col("_asof"))
    if gazetteers:
        ready, extra = with_gazetteer_spans(ready, txt, gazetteers, out="_gaz"), extra + ["_gaz"]
        parts.append(F.col("_gaz"))
    if external is not None:
        ready, extra = with_external_spans(ready, external, txt, key, "_ext"), extra + ["_ext"]
        parts.append(F.col("_ext"))
    found = F.concat(no_spans(), *parts)
    usable = F.when(F.length(txt) > 0, confident(found, min_score)).otherwise(no_spans())
    return ready.withColumn(out, usable).drop(*extra)


def anonymize(df: DataFrame, txt: str = "text", out: str = "result", mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """Add ``struct(anonymized_text, original_length, items_changed, entities)``.

    ``items_changed`` counts detections before overlaps are resolved.  Options
    are those of :func:`detect`.
    """
    found = detect(df, txt, out="_spans", **options)
    ordered = settled(found, "_spans", in_text_order("_spans"))
    ordered = ordered.withColumn("_kept", resolve_overlaps("_spans"))
    result = F.struct(
        F.when(F.size("_spans") > 0, replace_spans(txt, "_kept", mapping))
        .otherwise(F.col(txt))
        .alias("anonymized_text"),
        F.length(txt).alias("original_length"),
        F.size("_spans").alias("items_changed"),
        F.transform(
            "_spans",
            lambda s: F.struct(
                s.entity_type.alias("entity_type"), s.text.alias("text"), s.score.alias("score")
            ),
        ).alias("entities"),
    )
    return ordered.withColumn(out, result).drop("_spans", "_kept")


def resolved(found: DataFrame, spans: str = "spans") -> DataFrame:
    """The best of overlapping spans, in text order."""
    return settled(found, spans, F.col(spans)).withColumn(spans, resolve_overlaps(spans))


def entities(found: DataFrame, spans: str = "spans", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per detected entity."""
    return unpack(found, spans, keep)


def audit_counts(found: DataFrame, by: Sequence[str] = (), spans: str = "spans") -> DataFrame:
    """Findings per entity type, without any text."""
    types = F.transform(spans, lambda s: s.entity_type)
    exploded = found.select(*by, F.explode(types).alias("entity_type"))
    return exploded.groupBy(*by, "entity_type").agg(F.count("*").alias("n"))


def type_counts(df: DataFrame, txt: str = "text", deny_terms=(), recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS, gazetteers: dict[str, object] | None = None, min_score: float = MIN_SPAN_SCORE, out: str = "type_counts") -> DataFrame:
    """Add how many detections of each entity type a text has: ``array<struct<entity_type, n>>``.

    The numbers of :func:`detect`, but no match is given a place.
    """
    parts, ready, extra = [], df, []
    for r in recognizers:
        live = [portable_regex(p) for _, p, score in r.patterns if score >= min_score]
        if live:
            n = reduce(lambda a, b: a + b, [F.size(F.regexp_extract_all(F.col(txt), F.lit(p), F.lit(0))) for p in live])
            n = F.when(contains_any(txt, r.needs), n).otherwise(0) if r.needs else n
            parts.append(F.array(F.struct(F.lit(r.entity_type).alias("entity_type"), n.cast("bigint").alias("n"))))
    listed = [("INTERNAL_SENSITIVE", deny_terms, DENY_SCORE, False)] if isinstance(deny_terms, DataFrame) or deny_terms else []
    listed += [(t, words, GAZETTEER_SCORE, True) for t, words in (gazetteers or {}).items()]
    listed = [k for k in listed if k[2] >= min_score]
    if listed:
        ready, extra = with_term_spans(ready, txt, listed, "_listed"), ["_listed"]
        parts.append(F.transform("_listed", lambda s: F.struct(s.entity_type.alias("entity_type"), F.lit(1).cast("bigint").alias("n"))))
    none = F.array().cast("array<struct<entity_type:string,n:bigint>>")
    counts = F.when(F.length(txt) > 0, F.filter(F.concat(none, *parts), lambda x: x.n > 0)).otherwise(none)
    return ready.withColumn(out, counts).drop(*extra)


def count_by_type(df: DataFrame, by: Sequence[str] = (), rollup: bool = False, **options) -> DataFrame:
    """Detections per entity type, or with ``rollup`` also per group and over everything.

    Options are those of :func:`type_counts`.
    """
    rows = unpack(type_counts(df, out="_counts", **options), "_counts", by)
    grouped = rows.rollup(*by, "entity_type") if rollup else rows.groupBy(*by, "entity_type")
    return grouped.agg(F.sum("n").alias("n"))


def audit_rollup(found: DataFrame, by: str, spans: str = "spans") -> DataFrame:
    """Findings per group and type, per group, and over everything."""
    types = F.transform(spans, lambda s: s.entity_type)
    exploded = found.select(by, F.explode(types).alias("entity_type"))
    return exploded.rollup(by, "entity_type").agg(F.count("*").alias("n"))


def placeholder_counts(df: DataFrame, txt: str, legend_only: bool = False) -> DataFrame:
    """How often each placeholder occurs in anonymized text, with its group."""
    rows = df.select(F.explode(F.regexp_extract_all(F.col(txt), F.lit("<[A-Z]+>"), 0)).alias("placeholder"))
    counts = rows.groupBy("placeholder").agg(F.count("*").alias("n"))
    table = F.create_map(*[F.lit(x) for k, v in PLACEHOLDER_GROUPS.items() for x in (k, v)])
    known = counts.where(F.col("placeholder").isin(LEGEND_PLACEHOLDERS if legend_only else list(PLACEHOLDER_GROUPS)))
    return known.select("placeholder", table[F.col("placeholder")].alias("display_group"), "n")


class DenyList:
    """The active deny list: read once, replaceable, each plan uses its state."""

    def __init__(self, spark, path: str | None = None, entries: Sequence[str] | None = None):
        self.spark, self.path, self.entries = spark, path, []
        self.reload(entries)

    def reload(self, entries: Sequence[str] | None = None) -> dict:
        from textveil.sources.words import read_deny_list

        if entries is None:
            rows = read_deny_list(self.spark, self.path).orderBy("ord").collect() if self.path else []
            entries = [r["term"] for r in rows]
        self.entries = list(entries)
        return self.status()

    def status(self) -> dict:
        return {"success": True, "entry_count": len(self.entries), "entries": list(self.entries)}


