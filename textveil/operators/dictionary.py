"""Word dictionaries: cleaning, size checks and matching against text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textveil.functions.regex import WORD
from textveil.functions.text import let, norm_tokens, squash_ws, strip_ws, words as words_of
from textveil.operators.ranking import kept

# Up to this many words and bytes a list is sent to all executors.
MAX_BROADCAST_WORDS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
# A term is looked up by so many of its first words.
ANCHOR_WORDS = 8


def clean_word_list(df: DataFrame, col: str = "word", min_len: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """Distinct words: strip whitespace, then ``"``, keep ``min_len`` and up.

    ``exclude`` (safe words) is removed afterwards.
    """
    word = F.regexp_replace(strip_ws(F.col(col)), '^"+|"+$', "")
    out = df.select(word.alias("word")).where(F.length("word") >= min_len).distinct()
    if exclude is not None:
        out = out.join(exclude.select("word"), "word", "left_anti")
    return out


def words_frame(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def held_words(words, most: int | None = None, most_bytes: int | None = None) -> list[str] | None:
    """All distinct words of a list or frame, or None when they are too many to be sent around."""
    most = MAX_BROADCAST_WORDS if most is None else most
    most_bytes = MAX_BROADCAST_BYTES if most_bytes is None else most_bytes
    if words is None:
        return []
    if isinstance(words, DataFrame):
        one = words.select("word").where("word is not null").distinct()
        if not _small(one, most, most_bytes):
            return None
        found = [r[0] for r in one.collect()]
    else:
        found = [w for w in words if w is not None]
    found = sorted(set(found))
    return found if len(found) <= most and sum(map(len, found)) <= most_bytes else None


def as_frame(spark: SparkSession, words) -> DataFrame:
    if isinstance(words, DataFrame):
        return words.select("word").distinct()
    return words_frame(spark, sorted(set(words or [])))


def dictionary_stats(**dictionaries: DataFrame) -> DataFrame:
    """One row per dictionary with its number of distinct words."""
    parts = [
        d.select(F.lit(name).alias("dictionary"), F.col("word"))
        for name, d in dictionaries.items()
    ]
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    names = allrows.sparkSession.createDataFrame([(n,) for n in dictionaries], "dictionary string")
    counts = allrows.groupBy("dictionary").agg(F.countDistinct("word").alias("words"))
    return names.join(counts, "dictionary", "left").select(
        "dictionary", F.coalesce("words", F.lit(0)).cast("bigint").alias("words")
    )


def _small(dictionary: DataFrame, most: int | None = None, most_bytes: int | None = None) -> bool:
    """Whether a dictionary's rows and bytes, both counted, may go to all executors."""
    most = MAX_BROADCAST_WORDS if most is None else most
    most_bytes = MAX_BROADCAST_BYTES if most_bytes is None else most_bytes
    texts = [c for c, kind in dictionary.dtypes if kind == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    n, total = dictionary.agg(F.count("*"), F.sum(size)).first()
    return n <= most and (total or 0) <= most_bytes


def held_lists(df: DataFrame, words: Column, lists: Sequence, strategy: str = "auto", always: str | None = None, by_anchor: bool = False, most: int | None = None) -> list[list[str]] | None:
    """The entries of each list that matter to ``df``, if they can be sent to all executors.

    Lists of counted, bounded size are taken whole.  Larger ones (or all, with the
    strategy ``join``) are cut down to the entries that occur: only the distinct
    ``words`` of the texts and the entries are shuffled, never a text, and where the
    entries' words are few, only those of the texts' words that are among them.
    Entries that match the pattern ``always`` stay.  With ``by_anchor`` an entry occurs if its
    anchor does (see :func:`anchored`); ``words`` are the texts' anchors then, made
    for the lengths asked for.
    """
    if strategy != "join":
        held = [held_words(x, most) for x in lists]
        if None not in held:
            return held
    if df.isStreaming:
        raise ValueError("this list is too large for the executors' memory; use streaming.jobs.rewrite_batches")
    frames = [as_frame(df.sparkSession, x).select(F.lit(i).alias("list"), "word") for i, x in enumerate(lists)]
    entries = reduce(DataFrame.unionByName, frames).where("word <> ''")
    if by_anchor:
        keyed = anchored(entries, "list")
        lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # ANCHOR_WORDS + 1 at most
        words = anchors(words, lengths)
    else:
        keyed = entries.withColumn("term", F.col("word"))
    said, looked_up = df.select(F.explode(F.array_distinct(words)).alias("word")), keyed.select("word").distinct()
    if _small(looked_up):
        said = said.join(F.broadcast(looked_up), "word", "left_semi")
    seen = kept(said.distinct(), "words")  # once for all lists, and for counting and fetching
    occur = keyed.join(seen, "word", "left_semi")
    if always:
        occur = occur.unionByName(keyed.where(F.col("word").rlike(always)))
    occur = occur.select("list", F.col("term").alias("word")).distinct()
    if not _small(occur, most):
        return None
    out: list[list[str]] = [[] for _ in lists]
    for r in occur.collect():
        out[r["list"]].append(r["word"])
    return out


def matched_words(df: DataFrame, key: str, words: Column, dictionary: DataFrame) -> DataFrame:
    """``(key, kind, term)`` for each dictionary entry whose ``word`` is among a row's words.

    For dictionaries of any size: one of counted, bounded size is broadcast, so
    that only matches are shuffled later.  A larger one is first cut down to the
    words that occur at all, counted once in the map tasks, and what is still too
    large is joined by word, where adaptive execution splits the rows of a hot one.
    """
    found = df.select(key, F.explode(F.array_distinct(words)).alias("word"))
    if not _small(dictionary):
        dictionary = dictionary.join(found.select("word").distinct(), "word", "left_semi")
        if not _small(dictionary):
            return found.join(dictionary, "word").select(key, "kind", "term")
    return found.join(F.broadcast(dictionary), "word").select(key, "kind", "term")


def with_matches(df: DataFrame, txt: str, words: Column, kinds: dict[str, DataFrame]) -> DataFrame:
    """Add one array column ``_hits_<kind>`` of matched entries per dictionary.

    A dictionary has a column ``word`` that is looked up and may have one ``term``
    that is returned for it.  Rows meet their hits by a digest of the text: equal
    texts have equal hits, whatever ids the rows have, null ones included.
    """
    if df.isStreaming:
        raise ValueError("a list of this size needs a join; use streaming.jobs.rewrite_batches")
    parts = [
        d.select("word", F.col("term" if "term" in d.columns else "word").alias("term"), F.lit(kind).alias("kind"))
        for kind, d in kinds.items()
    ]
    dictionary = reduce(DataFrame.unionByName, parts)
    keyed = df.withColumn("_digest", F.sha2(txt, 256))
    hits = (
        matched_words(keyed, "_digest", words, dictionary.distinct())
        .groupBy("_digest")
        .agg(
            *[
                F.collect_set(F.when(F.col("kind") == kind, F.col("term"))).alias(f"_hits_{kind}")
                for kind in kinds
            ]
        )
    )
    out = keyed.join(hits, "_digest", "left").drop("_digest")
    empty = F.array().cast("array<string>")
    for kind in kinds:
        out = out.withColumn(f"_hits_{kind}", F.coalesce(f"_hits_{kind}", empty))
    return out


def anchored(terms: DataFrame, *keep: str) -> DataFrame:
    """``(word, term, n)``: what must be in a text for a term to be in it.

    That is the term's first words, ANCHOR_WORDS (``n``) at most, or the first character
    of a term that has no word (``n`` = 0).
    """
    parts = words_of("term")
    n = F.least(F.size(parts), F.lit(ANCHOR_WORDS))
    head = F.array_join(F.slice(parts, 1, ANCHOR_WORDS), " ")
    return terms.where("word <> ''").select(*keep, F.col("word").alias("term")).select(
        *keep, F.when(n > 0, head).otherwise(F.substring("term", 1, 1)).alias("word"), "term", n.alias("n")
    )


def anchors(txt: str, lengths: Iterable[int]) -> Column:
    """All anchors of the given lengths in a text."""
    def grams(w, n):
        if n == 0:
            return F.filter(F.split(txt, ""), lambda c: ~c.rlike(WORD))
        if n == 1:
            return w
        last = F.size(w) - (n - 1)
        at = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        return F.when(last > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(
            F.array().cast("array<string>")
        )

    none = F.array().cast("array<string>")
    return let(words_of(txt), lambda w: F.concat(none, *[grams(w, n) for n in lengths]))


def with_terms(df: DataFrame, txt: str, kinds: dict[str, object]) -> DataFrame:
    """Add ``_hits_<kind>``: the entries of each list that can be in the text.

    Entries may have any number of words, or none; their exact match is left to a
    pattern of the row's few entries.
    """
    frames = {kind: anchored(as_frame(df.sparkSession, listed)) for kind, listed in kinds.items()}
    every = reduce(DataFrame.unionByName, [f.select("n") for f in frames.values()])
    lengths = sorted(r["n"] for r in every.distinct().collect())  # ANCHOR_WORDS + 1 at most
    return with_matches(df, txt, anchors(txt, lengths), frames)


def rewrite_tokens(squashed, choose) -> Column:
    """Rejoin tokens after ``choose(token, normalised)`` picked each one."""
    s = F.col(squashed) if isinstance(squashed, str) else squashed
    return F.array_join(F.zip_with(F.split(s, " ", -1), norm_tokens(s), choose), " ")


__all__ = [
    "anchored",
    "anchors",
    "as_frame",
    "clean_word_list",
    "dictionary_stats",
    "held_lists",
    "held_words",
    "matched_words",
    "rewrite_tokens",
    "squash_ws",
    "with_matches",
    "with_terms",
    "words_frame",
]
