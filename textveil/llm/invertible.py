"""Document fingerprints that tell how much two versions differ, and in what.

A text is cut into paragraphs: its lines, those beyond a fixed length cut at it.
The digests of its paragraphs go into an invertible Bloom lookup sketch: each into
three cells, which hold a count and the exclusive or of digests and of their checks.
Subtracting the sketches of two versions leaves the digests they do not share;
peeling cells that hold one takes these out again.  What does not peel is built anew
with four times the cells, dealt by a hash of the digest to four parts with cells of
their own; parts that peel are done, and the others go on.  So a long text costs its
digests times the logarithm of how many differ, not times its cells.

Two short pieces from the beginning count as digests too, so that texts of a single
paragraph can be partly alike.

Everything is SQL functions on the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.operators.ranking import range_of

CELLS = 16  # in each of three tables
MORE = 4
RETRIES = 12
ROUNDS = 12
CHECK = 7
LONGEST = 1024  # characters of a paragraph
OPENING = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs and of its opening."""
    found = F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{LONGEST}}}\n?|\n"), F.lit(0))
    opening = F.array(*[F.substring(text, 1 + i * OPENING, OPENING) for i in range(2)])
    short = F.transform(F.filter(opening, lambda p: p != ""), lambda p: F.xxhash64(p, F.lit(1)))
    return F.array_distinct(F.concat(F.transform(found, lambda p: F.xxhash64(p, F.lit(0))), short))


def _places(key: Column, retry: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j), retry), F.lit(CELLS)).cast("int") + j * CELLS for j in range(3)]


def _marked(key: Column, check: Column, sign: Column, retry: Column) -> Column:
    at = [x.alias(f"i{j}") for j, x in enumerate(_places(key, retry))]
    return F.struct(sign.cast("int").alias("n"), key.alias("k"), check.alias("h"), *at)


def _add(cell: Column, item: Column, sign: int) -> Column:
    return F.struct(
        (cell["n"] + sign * item["n"]).cast("int").alias("n"), cell["k"].bitwiseXOR(item["k"]).alias("k"), cell["h"].bitwiseXOR(item["h"]).alias("h")
    )


def sketch(digests: Column, retry: Column) -> Column:
    """Three tables of cells, one after another; each retry has its own places."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    marked = F.transform(digests, lambda u: _marked(u, F.xxhash64(u, F.lit(CHECK)), F.lit(1), retry))

    def tables(m: Column) -> Column:
        def one(j: int) -> Column:
            def cell(i: Column) -> Column:
                return F.aggregate(F.filter(m, lambda x: x[f"i{j}"] == i), zero, lambda a, x: _add(a, x, 1))

            return F.transform(F.sequence(F.lit(j * CELLS), F.lit(j * CELLS + CELLS - 1)), cell)

        return F.flatten(F.array(one(0), one(1), one(2)))

    return let(marked, tables)


def subtract(a: Column, b: Column) -> Column:
    """What one sketch holds beyond another, and the other way round."""
    return F.zip_with(a, b, lambda x, y: _add(x, y, -1))


def none() -> Column:
    return F.array().cast("array<bigint>")


def peel(cells_left: Column, retry: Column) -> Column:
    """The digests of a difference of sketches: ``lost`` of the first text only, ``gained`` of the second; null if it does not peel."""

    def pure(left: Column) -> Column:
        alone = F.filter(left, lambda x: (F.abs(x["n"]) == 1) & (x["h"] == F.xxhash64(x["k"], F.lit(CHECK))))
        return F.array_distinct(F.transform(alone, lambda x: _marked(x["k"], x["h"], x["n"], retry)))

    def step(s: Column, _: Column) -> Column:
        def take(p: Column) -> Column:
            def rest(x: Column, i: Column) -> Column:
                here = F.filter(p, lambda y: (y["i0"] == i) | (y["i1"] == i) | (y["i2"] == i))
                return F.aggregate(here, x, lambda a, y: _add(a, y, -1))

            def keys(name: str, sign: int) -> Column:
                return F.concat(s[name], F.transform(F.filter(p, lambda y: y["n"] == sign), lambda y: y["k"])).alias(name)

            after = F.struct(F.transform(s["left"], rest).alias("left"), keys("lost", 1), keys("gained", -1))
            return F.when(F.size(p) == 0, s).otherwise(after)

        return let(pure(s["left"]), take)

    start = F.struct(cells_left.alias("left"), none().alias("lost"), none().alias("gained"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    clear = lambda s: F.forall(s["left"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    return let(end, lambda s: F.when(clear(s), F.struct(s["lost"].alias("lost"), s["gained"].alias("gained"))))


def _parts(a: Column, b: Column, retry: Column) -> Column:
    """The digests of both texts dealt to MORE parts."""

    def own(digests: Column, i: int) -> Column:
        return F.filter(digests, lambda u: F.pmod(F.xxhash64(u, F.lit(CHECK), retry), F.lit(MORE)) == i)

    return F.array(*[F.struct(own(a, i).alias("a"), own(b, i).alias("b")) for i in range(MORE)])


def _retried(a: Column, b: Column) -> Column:
    """``lost`` and ``gained`` of two texts whose first sketches did not peel.

    Parts left after the last retry are compared by their digests.
    """

    def tried(part: Column, retry: Column) -> Column:
        # so many more on one side cannot peel
        few = F.abs(F.size(part["a"]) - F.size(part["b"])) <= 3 * CELLS
        found = F.when(few, peel(subtract(sketch(part["a"], retry), sketch(part["b"], retry)), retry))
        return F.struct(part["a"].alias("a"), part["b"].alias("b"), found.alias("found"))

    def step(s: Column, retry: Column) -> Column:
        def sorted_out(t: Column) -> Column:
            done = F.filter(t, lambda x: x["found"].isNotNull())
            open_ = F.filter(t, lambda x: x["found"].isNull())
            return F.struct(
                F.flatten(F.transform(open_, lambda x: _parts(x["a"], x["b"], retry))).alias("open"),
                F.concat(s["lost"], F.flatten(F.transform(done, lambda x: x["found"]["lost"]))).alias("lost"),
                F.concat(s["gained"], F.flatten(F.transform(done, lambda x: x["found"]["gained"]))).alias("gained"),
            )

        return F.when(F.size(s["open"]) == 0, s).otherwise(let(F.transform(s["open"], lambda x: tried(x, retry)), sorted_out))

    start = F.struct(_parts(a, b, F.lit(0)).alias("open"), none().alias("lost"), none().alias("gained"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, step)

    def whole(s: Column) -> Column:
        def rest(x: str, y: str) -> Column:
            return F.flatten(F.transform(s["open"], lambda p: F.array_except(p[x], p[y])))

        return F.struct(F.concat(s["lost"], rest("a", "b")).alias("lost"), F.concat(s["gained"], rest("b", "a")).alias("gained"))

    return let(end, whole)


def fingerprint_parts(text: Column) -> Column:
    """Digests of a text and their sketch."""
    return let(paragraphs(text), lambda a: F.struct(a.alias("digests"), sketch(a, F.lit(0)).alias("cells")))


def compare(a: Column, b: Column) -> Column:
    """What two fingerprints' texts do not share, ``lost`` and ``gained`` in order, and how alike they are.

    ``near`` is 1 less the share of digests that only one of the two has.
    """
    first = peel(subtract(a["cells"], b["cells"]), F.lit(0))
    found = let(first, lambda x: F.when(x.isNotNull(), x).otherwise(_retried(a["digests"], b["digests"])))
    total = F.size(a["digests"]) + F.size(b["digests"])

    def said(x: Column) -> Column:
        near = 1 - (F.size(x["lost"]) + F.size(x["gained"])) / F.greatest(total, F.lit(1))
        return F.struct(F.sort_array(x["lost"]).alias("lost"), F.sort_array(x["gained"]).alias("gained"), near.cast("double").alias("near"))

    return let(found, said)


def digest(parts: Column) -> Column:
    """A fingerprint as a string: the digest of its sketch."""
    return F.sha2(parts["cells"].cast("string"), 256)


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text of the next document by descending id.

    After the last comes the first again.  Ids are cut into ranges, and only the
    first text of each range goes to the range before it.  Null ids come last,
    equal ids in the order of their texts.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    ranges = range_of(ids, "doc_id")
    ranged = base.withColumn("_range", ranges)
    inside = Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), "text")
    local = ranged.withColumns({"_next": F.lead("text").over(inside), "_last": F.lead(F.lit(1)).over(inside).isNull()})
    # the highest id of each range, at most as many as there are ranges
    tops = ids.withColumn("_range", ranges).groupBy("_range").agg(F.max("doc_id").alias("_top"))
    above = Window.orderBy("_range")
    doors = tops.select(F.col("_range").alias("_to"), F.coalesce(F.lag("_top").over(above), F.max("_top").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_top"))
    least = base.join(F.broadcast(doors), base["doc_id"].eqNullSafe(doors["_top"])).groupBy("_to").agg(F.min("text").alias("_edge"))
    both = local.join(F.broadcast(least), F.col("_last") & (F.col("_range") == F.col("_to")), "left")
    return both.select("doc_id", "text", F.coalesce("_next", "_edge", F.lit("")).alias("next"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edited version of it, and how alike they are.

    The edit replaces the last third of a text (rounded down) with as much of the
    beginning of the next text by descending id.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    digests that only the text has (edited_lost, next_lost) or only the edited
    version or the next text (edited_gained, next_gained).

    Digests are of distinct paragraphs: their order and how often one comes do not
    count.

    A null text is empty; two empty texts are alike (1).  Repeated rows and equal
    texts have equal fingerprints; a table of one row has itself as the next; an
    empty table gives an empty result.  Other columns are not looked at.
    """
    both = with_next_text(docs)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next, 1, cast(floor(length(text) / 3) as int))"))

    def all_of(x: Column) -> Column:
        edited, following = compare(x["own"], x["edited"]), compare(x["own"], x["next"])
        return let(F.struct(edited.alias("edited"), following.alias("next")), lambda y: F.struct(
            digest(x["own"]).alias("fingerprint"), digest(x["edited"]).alias("edited_fingerprint"),
            y["edited"]["near"].alias("near_edited"), y["next"]["near"].alias("near_next"),
            *[y[v][c].alias(f"{v}_{c}") for v in ("edited", "next") for c in ("lost", "gained")],
        ))

    def prints(e: Column) -> Column:
        parts = F.struct(fingerprint_parts(F.col("text")).alias("own"), fingerprint_parts(e).alias("edited"), fingerprint_parts(F.col("next")).alias("next"))
        return F.struct(F.sha2(e.cast("binary"), 256).alias("edited_sha256"), let(parts, all_of).alias("near"))

    rows = both.select("doc_id", n.cast("bigint").alias("n_chars"), F.explode(F.array(let(edited, prints))).alias("p"))
    return rows.select("doc_id", "n_chars", "p.edited_sha256", "p.near.*")
