"""Column -> Column helpers for whitespace, tokens and previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textveil.constants import MAX_TOKENS, NUMBER_MASK, NUMBER_PATTERN
from textveil.functions.regex import (
    NO_SPACE,
    SPACE,
    SPACE_CHARS,
    WORD_CHARS,
    portable_regex,
    quote_replacement,
)


def as_col(txt) -> Column:
    return F.col(txt) if isinstance(txt, str) else txt


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(txt) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(as_col(txt), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(txt) -> Column:
    """No character other than whitespace."""
    return ~as_col(txt).rlike(f"[^{SPACE_CHARS}]")


def squash_ws(txt) -> Column:
    """Every whitespace run becomes one space, the ends are trimmed.

    Single spaces, by far the most common run, are left alone by the pattern.
    """
    runs = f"(?! {NO_SPACE}){SPACE}+"
    return F.trim(F.regexp_replace(as_col(txt), runs, " "))


def tokens(txt) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(squash_ws(txt), " ", -1), lambda t: t != "")


def norm_token(token) -> Column:
    """The word characters of a token."""
    return F.regexp_replace(as_col(token), f"[^{WORD_CHARS}]+", "")


def norm_tokens(squashed) -> Column:
    """Normalised tokens of a squashed text, aligned with its own tokens.

    One pass over the whole text instead of one per token: spaces are kept, so
    a token of pure punctuation becomes an empty string in its place.
    """
    return F.split(F.regexp_replace(as_col(squashed), f"[^{WORD_CHARS} ]+", ""), " ", -1)


def words(txt) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(as_col(txt), F.lit(f"[{WORD_CHARS}]+"), 0)


def mask_numbers(txt, mask: str = NUMBER_MASK) -> Column:
    """Any run of three or more digits, also inside words."""
    return F.regexp_replace(
        as_col(txt), portable_regex(NUMBER_PATTERN), quote_replacement(mask)
    )


def strip_quotes(txt) -> Column:
    """Strip surrounding double quotes, then surrounding single quotes."""
    return F.regexp_replace(F.regexp_replace(as_col(txt), '^"+|"+$', ""), "^'+|'+$", "")


def preview(txt, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if something was cut."""
    c = as_col(txt)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate_tokens(txt, n: int = MAX_TOKENS) -> Column:
    """The first ``n`` whitespace tokens, joined by one space."""
    return F.substring_index(squash_ws(txt), " ", n)


def fill_template(template: str, **fields) -> Column:
    """``template`` with each ``{name}`` replaced by a column.

    The template is cut at its placeholders first, so text inside a column
    that looks like a placeholder is left alone.
    """
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{%s}" % k), k) for k in fields if "{%s}" % k in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(as_col(fields[key]))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def hash_key(seed, *ids) -> Column:
    """A 32-digit hex key per row; ordering by it is a seeded shuffle.

    It depends on the row's id only, so it survives repartitioning and reruns.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(i).cast("string") for i in ids]))
