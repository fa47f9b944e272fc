"""Sums over the words of texts, against tables of words of any size.

A text's words are counted within its row, so no (text, word) pair is gathered by
key.  Most pairs have one of the frequent words, which are a broadcast of bounded
size; only pairs with another word are shuffled.  Whatever the split, each pair
meets its word's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textveil.functions.arrays import unpack
from textveil.functions.text import let

# So many rows of a word table are sent to all executors, none with a longer word than this.
HELD_ROWS = 200_000
HELD_LENGTH = 64


def counted_words(tokens: Column) -> Column:
    """``array<struct<word, tf>>`` of an array of words, in the order of the words."""
    def runs(s):
        at = F.sequence(F.lit(0), F.size(s) - 1)
        firsts = F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def counted(begin):
            def one(i, k):
                return F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(begin, k + 1), F.size(s)) - i).cast("bigint").alias("tf"))

            return F.transform(begin, one)

        return F.when(F.size(s) > 0, let(firsts, counted))

    return let(F.sort_array(tokens), runs)


def word_pairs(texts: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """``(*keep, word, tf)`` of each row's own words."""
    return unpack(texts.select(*keep, counted_words(tokens).alias("_words")), "_words", keep)


class WordTable:
    """A table with a column ``word``, cut into its frequent words and the rest.

    ``often`` is a whole number that is the same in all rows of a word.  The table is
    read several times, so it should be a stored one.
    """

    def __init__(self, table: DataFrame, often: str, most: int | None = None):
        most = HELD_ROWS if most is None else most
        level = F.floor(4 * F.log2(1.0 + F.coalesce(often, F.lit(0)))).cast("int")
        leveled = table.withColumn("_level", F.when(F.length("word") <= HELD_LENGTH, level).otherwise(-1))
        sizes = {r["_level"]: r["n"] for r in leveled.groupBy("_level").agg(F.count("*").alias("n")).collect()}
        cut, total = max(sizes, default=0) + 1, 0
        for at in sorted(sizes, reverse=True):
            if at < 0 or total + sizes[at] > most:
                break
            cut, total = at, total + sizes[at]
        self.held = leveled.where(F.col("_level") >= cut).drop("_level") if total else None
        self.rest = leveled.where(F.col("_level") < cut).drop("_level")
        self.whole = total == sum(sizes.values())  # nothing is left over

    def parts(self, pairs: DataFrame, unknown: bool = False) -> list[DataFrame]:
        """``pairs`` with the table's columns, those of frequent words first, then the others.

        With ``unknown`` the last part also has the pairs whose word the table lacks.
        """
        how = "left" if unknown else "inner"
        if self.held is None:
            return [pairs.join(self.rest, "word", how)]
        near = pairs.join(F.broadcast(self.held), "word")
        if self.whole and not unknown:
            return [near]
        known = F.broadcast(self.held.select("word").distinct())
        return [near, pairs.join(known, "word", "left_anti").join(self.rest, "word", how)]


def sums_by_text(texts: DataFrame, key: str, tokens: Column, table: WordTable, sums: dict[str, Column], unknown: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *by, *sums)``: sums over a text's words, of ``tf`` and the table's columns.

    ``texts`` has one row for each key and should be partitioned by it.  ``by`` are
    columns of the table.
    """
    keep = [key, *by]
    pairs = word_pairs(texts, [key], tokens)

    parts = [
        part.groupBy(*keep).agg(*[F.sum(x).alias(name) for name, x in sums.items()])
        for part in table.parts(pairs, unknown)
    ]
    if len(parts) == 1:
        return parts[0]
    return _added(parts[0], parts[1], keep, list(sums))


def _added(near: DataFrame, far: DataFrame, keep: list[str], sums: list[str]) -> DataFrame:
    """The sums of both frames, each with one row for each ``keep``, added up.

    A join and not a union: Spark 4.1 may plan a union of two frames that are dealt out
    alike as one that is still dealt out by key, and then not run it as such.
    """
    other = far.select(*[F.col(c).alias(f"_far_{c}") for c in [*keep, *sums]])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_far_{c}")) for c in keep])
    both = near.join(other, same, "full")
    total = lambda c: F.coalesce(F.col(c) + F.col(f"_far_{c}"), c, f"_far_{c}")
    return both.select(*[F.coalesce(c, f"_far_{c}").alias(c) for c in keep], *[total(c).alias(c) for c in sums])
