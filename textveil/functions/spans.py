"""Entity spans as array columns: find, filter, resolve, replace.

A span is ``struct<entity_type, start, end, score, text>`` with code-point
offsets, end exclusive.  All functions are Column -> Column and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from textveil.constants import DEFAULT_PLACEHOLDER, ENTITY_LABELS, MIN_SPAN_SCORE
from textveil.functions.lookup import Terms, find_terms, without_overlaps
from textveil.functions.regex import WORD, portable_regex
from textveil.functions.text import as_col, let

# Spans of a text are worked on in pieces of this many, and these in smaller ones.
BLOCK = 256
SMALL_BLOCK = 16
_MARK = "\x01"  # stands around matches; texts that hold it take the longer way
SPAN_DDL = "struct<entity_type:string,start:int,end:int,score:double,text:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN_DDL}>")


def _span(entity_type, start, end, score, text) -> Column:
    return F.struct(
        F.lit(entity_type).cast("string").alias("entity_type"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.lit(score).cast("double").alias("score"),
        text.alias("text"),
    )


def regex_spans(txt, regex, entity_type: str, score: float) -> Column:
    """Spans of all matches of a Java ``regex`` (a string or a column).

    One pass over the text marks where matches begin and end; cut there, it is gaps
    and matches in turn, and one running position over both gives every offset.  Where
    the text holds the mark itself, matches and gaps are found one after the other.
    """
    c = as_col(txt)
    regex = F.lit(regex) if isinstance(regex, str) else regex

    def place(steps):
        sizes = F.transform(steps, lambda s: s.gap + F.length(s.m))
        before = let(sizes, lambda xs: before_each(xs, lambda a, x: a + x))
        return F.zip_with(
            steps, before, lambda s, b: _span(entity_type, b + s.gap, b + s.gap + F.length(s.m), score, s.m)
        )

    def paired(parts):
        at = F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)
        return F.transform(
            at, lambda i: F.struct(F.get(parts, i * 2 + 1).alias("m"), F.length(F.get(parts, i * 2)).alias("gap"))
        )

    def fold(matches):
        steps = F.filter(
            F.zip_with(
                matches,
                F.split(c, regex, -1),
                lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")),
            ),
            lambda s: s.m.isNotNull(),
        )
        return F.when(F.size(matches) > 0, let(steps, place)).otherwise(no_spans())

    def cut(parts):
        return F.when(F.size(parts) > 1, let(paired(parts), place)).otherwise(no_spans())

    marked = F.split(F.regexp_replace(c, regex, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(c.contains(_MARK), let(F.regexp_extract_all(c, regex, 0), fold)).otherwise(let(marked, cut))


def blocks(values, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size``, without any for an empty one."""
    def cut(c):
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c) / size), F.lit(1)).cast("int") - 1)
        return F.filter(F.transform(at, lambda b: F.slice(c, b * size + 1, size)), lambda x: F.size(x) > 0)

    return let(as_col(values), cut)


def before_each(values, combine) -> Column:
    """For each of some integers, what ``combine`` makes of 0 and all those before it.

    ``combine`` is associative.  An array that grows in a fold is copied at each
    step, so blocks are folded first and each one then starts from the earlier ones'
    result: the work grows with the number of values, not with its square.
    """
    none = F.array().cast("array<int>")

    def running(xs, first):
        start = F.struct(first.cast("int").alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(
            combine(acc.at, x).cast("int").alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")
        )
        return F.aggregate(xs, start, step, lambda acc: acc.out)

    def joined(bs):
        totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: combine(a, x).cast("int")))
        return F.flatten(F.zip_with(bs, running(totals, F.lit(0)), running))

    c = as_col(values)
    return F.when(F.size(c) <= SMALL_BLOCK, running(c, F.lit(0))).otherwise(let(blocks(c, 2 * SMALL_BLOCK), joined))


def contains_any(txt, needs: str | tuple[str, ...]) -> Column:
    """Cheap check: a Java pattern, or any of several literal strings."""
    c = as_col(txt)
    if isinstance(needs, str):
        return c.rlike(needs)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needs])


def pattern_spans(txt, pattern: str, entity_type: str, score: float, needs=None) -> Column:
    """Spans of a Perl-style ``pattern``.

    ``needs`` is an optional cheap condition that every match implies (see
    :func:`contains_any`); texts without it skip the work.
    """
    c = as_col(txt)
    spans = regex_spans(c, portable_regex(pattern), entity_type, score)
    return F.when(contains_any(c, needs), spans).otherwise(no_spans()) if needs else spans


def term_spans(txt, terms: Sequence[str], entity_type: str, score: float) -> Column:
    """Spans of literal terms, bounded by non-word characters, longest first."""
    terms = [t for t in terms if t]
    return find_terms(txt, [Terms(entity_type, terms, score)]) if terms else no_spans()


def escaped(term: Column) -> Column:
    """A term as a pattern that matches exactly itself."""
    return F.regexp_replace(term, r"([^\w\s]|_)", r"\\$1")


def hit_spans(txt, hits, entity_type: str, score: float, merge: bool = False) -> Column:
    """Spans of the entries in the array column ``hits``.

    The pattern is built per row from the few entries that can occur in it.  With
    ``merge``, hits that are separated by one space form one span.
    """
    hits = as_col(hits)
    longest_first = F.reverse(F.array_sort(hits))  # of those with a common beginning
    body = F.concat(F.lit("(?:"), F.array_join(F.transform(longest_first, escaped), "|"), F.lit(")"))
    before, after = F.lit(f"(?<!{WORD})"), f"(?!{WORD})"
    bounded = F.concat(before, body, F.lit(after))
    regex = bounded
    if merge:
        regex = F.concat(bounded, F.lit("(?: "), body, F.lit(after + ")*"))
    return F.when(F.size(hits) > 0, regex_spans(txt, regex, entity_type, score)).otherwise(no_spans())


def confident(spans, min_score: float = MIN_SPAN_SCORE) -> Column:
    return F.filter(as_col(spans), lambda s: s.score >= min_score)


def in_text_order(spans) -> Column:
    """Spans by start, longer first, then type and score."""
    keyed = F.transform(
        as_col(spans),
        lambda s: F.struct(
            s.start.alias("a"), (-s.end).alias("b"), s.entity_type.alias("c"), (-s.score).alias("d"), s.alias("s")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k.s)


def resolve_overlaps(spans) -> Column:
    """Keep the best spans so that none overlap, in text order.

    Best = higher score, then longer, then earlier, then entity type.
    """
    return without_overlaps(spans)


def label_of(entity_type, mapping: dict[str, str] | None = None, default: str = DEFAULT_PLACEHOLDER) -> Column:
    """Placeholder of an entity type; unmapped types get the default."""
    mapping = ENTITY_LABELS if mapping is None else mapping
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[as_col(entity_type)], F.lit(default))


def replace_spans(txt, kept, mapping: dict[str, str] | None = None) -> Column:
    """Replace non-overlapping spans, in text order, by their placeholders.

    Cutting at a position reads a text from its beginning, so spans of one piece of the
    text are worked on together, and pieces are cut from larger ones.
    """

    def part(text, b, first):
        def one(s, i):
            begin = F.when(i == 0, first).otherwise(F.get(b, i - 1).end)
            return let(begin, lambda at: F.concat(F.substring(text, at - first + 1, s.start - at), label_of(s.entity_type, mapping)))

        return F.array_join(F.transform(b, one), "")

    def rewritten(text, spans, first, size):
        """``text``, which begins at ``first``, up to the last of the spans."""
        def piece(b, begin):
            # positions are counted from the block's own piece of the text
            cut = F.substring(text, begin - first + 1, F.element_at(b, -1).end - begin)
            inner = part if size <= SMALL_BLOCK else lambda t, x, at: rewritten(t, x, at, SMALL_BLOCK)
            return let(cut, lambda t: inner(t, b, begin))

        def whole(bs):
            firsts = F.transform(bs, lambda b, i: F.when(i == 0, first).otherwise(F.element_at(F.get(bs, i - 1), -1).end))
            return F.array_join(F.zip_with(bs, firsts, piece), "")

        return let(blocks(spans, size), whole)

    c, spans = as_col(txt), as_col(kept)
    last = F.when(F.size(spans) > 0, F.element_at(spans, -1).end).otherwise(0)
    return F.concat(rewritten(c, spans, F.lit(0), BLOCK), F.substring(c, last + 1, F.length(c)))
