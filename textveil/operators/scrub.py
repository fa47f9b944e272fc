"""Rule and dictionary scrubbing of a text column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textveil.constants import LOCATION_MASK, PERSON_MASK, SCRUB_RULES
from textveil.functions.regex import portable_regex, quote_replacement
from textveil.functions.lookup import mask_words
from textveil.functions.spans import contains_any
from textveil.functions.text import as_col, let, mask_numbers, norm_tokens, squash_ws
from textveil.operators.dictionary import as_frame, held_lists, rewrite_tokens, with_matches

# Every default rule needs a digit or an at sign, and each one more than that.
DEFAULT_NEEDS = r"[\p{Nd}@]"
RULE_NEEDS = {
    "MEDICAL_ID": r"\p{Nd}{9}",
    "IBAN": ("DE",),
    "PHONE": ("0", "+49"),
    "EMAIL": ("@",),
    "DATE_YEAR": ("19", "20"),
    "STREET": ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer"),
}


def rule_replace(txt, rule: str | tuple[str, str]) -> Column:
    """Replace all matches of one rule by its bracketed name.

    Default rules skip texts without what they need.
    """
    name, pattern = (rule, dict(SCRUB_RULES)[rule]) if isinstance(rule, str) else rule
    replaced = F.regexp_replace(as_col(txt), portable_regex(pattern), quote_replacement(f"[{name}]"))
    if dict(SCRUB_RULES).get(name) != pattern:
        return replaced
    return F.when(contains_any(txt, RULE_NEEDS[name]), replaced).otherwise(as_col(txt))


def apply_rules(txt, rules: Sequence[tuple[str, str]] | None = None, needs: str | None = None) -> Column:
    """Apply rules in order, each on the text left by the earlier ones.

    The default rules are skipped for texts without a digit or an at sign.  For
    own rules ``needs`` may name a cheap Java pattern that every match of every
    rule contains.
    """
    if rules is None:
        rules, needs = SCRUB_RULES, DEFAULT_NEEDS

    def step(text, rule):
        return let(text, lambda t: rule_replace(t, rule))

    if not needs:
        return reduce(step, rules, as_col(txt))

    def guarded(c):
        return F.when(c.rlike(needs), reduce(step, rules, c)).otherwise(c)

    return guarded(F.col(txt)) if isinstance(txt, str) else let(txt, guarded)


def mask_tokens(txt, words: Sequence[str], mask: str) -> Column:
    """Replace each whitespace token whose word characters are in ``words``."""
    return mask_dictionaries(txt, [(words, mask)])


def mask_dictionaries(txt, dictionaries: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Like :func:`mask_tokens` for several word lists, earlier lists win."""
    live = [(words, mask) for words, mask in dictionaries if len(words)]
    return mask_words(squash_ws(txt), live) if live else squash_ws(txt)


def mask_by_join(df: DataFrame, txt: str, names=None, cities=None, out: str | None = None) -> DataFrame:
    """The dictionary step where even the words that occur are too many to send around.

    Only pairs of a text's digest and a word are shuffled for matching; the text
    itself is shuffled once, by digest, to receive the few words found in it.
    """
    spark, out = df.sparkSession, out or txt
    ready = df.withColumn("_squashed", squash_ws(txt))
    kinds = {"name": as_frame(spark, names), "city": as_frame(spark, cities)}
    matched = with_matches(ready, "_squashed", norm_tokens("_squashed"), kinds)

    def choose(token, norm):
        return (
            F.when(F.array_contains("_hits_name", norm), PERSON_MASK)
            .when(F.array_contains("_hits_city", norm), LOCATION_MASK)
            .otherwise(token)
        )

    hit = (F.size("_hits_name") > 0) | (F.size("_hits_city") > 0)
    masked = F.when(hit, rewrite_tokens("_squashed", choose)).otherwise(F.col("_squashed"))
    return matched.withColumn(out, masked).drop("_squashed", "_hits_name", "_hits_city")


def scrub(
    df: DataFrame,
    txt: str = "text",
    names=None,
    cities=None,
    rules: Sequence[tuple[str, str]] | None = None,
    needs: str | None = None,
    out: str | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Rules, then dictionaries, then the digit fallback.

    ``names`` and ``cities`` are lists or frames with a column ``word``.  They are
    looked up in the row; lists beyond what executors can hold (with the strategy
    ``join`` all lists) are first cut down to the words that occur.
    """
    out = out or txt
    ruled = apply_rules(txt, rules, needs)
    # a token that a rule has not touched is a token of the raw text, too
    marks = "|".join(norm for name, _ in (SCRUB_RULES if rules is None else rules) for norm in re.findall(r"\w+", name))
    found = held_lists(df, norm_tokens(squash_ws(txt)), [names, cities], strategy, always=portable_regex(marks) if marks else None)
    if found is None:
        joined = mask_by_join(df.withColumn(out, ruled), out, names, cities)
        return joined.withColumn(out, mask_numbers(out))
    masked = mask_dictionaries(ruled, [(found[0], PERSON_MASK), (found[1], LOCATION_MASK)])
    return df.withColumn(out, mask_numbers(masked))


def placeholders(txt) -> Column:
    """All bracketed scrub labels in a scrubbed text."""
    return F.regexp_extract_all(as_col(txt), F.lit(r"\[[A-Z_]+\]"), 0)


def placeholder_census(scrubbed: DataFrame, txt: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """How often each scrub label occurs, per group."""
    found = scrubbed.select(*by, F.explode(placeholders(txt)).alias("label"))
    return found.groupBy(*by, "label").agg(F.count("*").alias("n"))
