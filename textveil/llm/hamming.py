"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments of nearly equal width.  A code that differs
by more than r bits in the segments 0 to s, and by r or more in the others, is farther
than ``m * r + s``, so searching segment after segment, radius by radius, covers one
more unit of distance at each step.  A query is done once its k-th verified distance
is covered; until then that distance bounds what still counts.  A pair comes up in
the segment where it differs least (the first such), so no pair comes up twice.

The number of segments is that of the least cost, probes and the rows they meet, for
the k-th distances of a bounded sample of queries.

Equal codes are one entry of the index with their k smallest ids, and equal query
codes are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.llm.frames import stored, with_group_values

BITS = 64
SAMPLE = 64  # queries that tell how far the k-th rows are


def sign_code(vector: str | Column) -> Column:
    """A bit for each of the first 64 elements: set where it is above 0; null counts as 0."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.coalesce(code, F.lit(0).cast("bigint"))


def _cuts(m: int) -> list[int]:
    """Edges of ``m`` segments of nearly the same width."""
    return [round(BITS * i / m) for i in range(m + 1)]


def _steps(m: int) -> Iterator[tuple[int, list[int]]]:
    """Radii and segments in the order they are searched: small radii in all segments at once."""
    for radius in range(BITS // m + 2):
        yield from [(radius, [*range(m)])] if radius <= 1 else [(radius, [s]) for s in range(m)]


def choose_segments(n: int, kth: Sequence[int], most: int = 16) -> int:
    """How many segments cost least: probes and the rows they meet, until distances like ``kth`` are covered."""
    def cost(m: int) -> float:
        width = [b - a for a, b in zip(_cuts(m), _cuts(m)[1:])]
        total = 0.0
        for far in kth:
            for radius, segments in _steps(m):
                total += sum(math.comb(width[s], radius) * (1 + n / 2 ** width[s]) for s in segments)
                if radius * m + segments[-1] >= far:
                    break
        return total

    return min(range(1, most + 1), key=cost) if kth else most


def _kth_distances(entries: DataFrame, asked: DataFrame, k: int) -> list[int]:
    """How far the k-th row is from each of SAMPLE queries."""
    some = [r["q"] for r in asked.orderBy(F.xxhash64("q")).limit(SAMPLE).collect()]
    each = F.transform(F.array(*map(F.lit, some)), lambda q: F.bit_count(q.bitwiseXOR(F.col("code"))))
    rows = entries.select(F.posexplode(each).alias("q", "d"), F.size("ids").alias("c")).groupBy("q", "d").agg(F.sum("c").alias("c"))
    cum = rows.withColumn("sum", F.sum("c").over(Window.partitionBy("q").orderBy("d")))
    near = cum.groupBy("q").agg(F.coalesce(F.min(F.when(F.col("sum") >= k, F.col("d"))), F.lit(BITS)).alias("d"))
    return [r["d"] for r in near.collect()]


def _segment(code: Column, cuts: list[int], i: int) -> Column:
    return F.shiftrightunsigned(code, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))


def _split(code: str, cuts: list[int]) -> Column:
    parts = [F.struct(F.lit(i).alias("s"), _segment(F.col(code), cuts, i).alias("v")) for i in range(len(cuts) - 1)]
    return F.explode(F.array(*parts))


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of ``codes`` for each row of ``queries``, itself among them.

    Both: id, code (bigint).  Columns: query_id, rank (from 1), id, distance; ties go
    by id.  Rows of null id are left out, null codes are 0; repeated ids count as
    often as they occur.  A table of fewer than k rows gives all of them; an empty
    one gives an empty result.
    """
    clean = [x.where("id is not null").select("id", F.coalesce("code", F.lit(0)).alias("code")) for x in (codes, queries)]
    first = Window.partitionBy("code").orderBy("id")
    kept = clean[0].withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    entries = stored(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = stored(clean[1].select("code").distinct().withColumnRenamed("code", "q"), "asked")
    m = choose_segments(entries.count(), _kth_distances(entries, asked, k))
    cuts = _cuts(m)
    index = stored(entries.select("code", _split("code", cuts).alias("e")).select("code", "e.*"), "segments")
    heads = entries.select("code", F.element_at("ids", 1).alias("i"), F.size("ids").alias("c"))
    open_ = asked.withColumn("limit", F.lit(BITS))
    near = Window.partitionBy("q").orderBy("d", "i")
    best, closed = None, []
    for radius, segments in _steps(m):
        parts = []
        for s in segments:  # a fixed list of flips for each segment
            flips = [sum(1 << x for x in c) for c in combinations(range(cuts[s + 1] - cuts[s]), radius)]
            if flips:
                own = open_.select("q", "limit", F.lit(s).alias("s"), _segment(F.col("q"), cuts, s).alias("_v"))
                values = F.transform(F.lit(flips), lambda x: F.col("_v").bitwiseXOR(x.cast("bigint")))
                parts.append(own.select("q", "limit", "s", F.explode(values).alias("v")))
        if not parts:
            continue
        apart = F.col("q").bitwiseXOR(F.col("code"))
        per = [F.bit_count(_segment(apart, cuts, i)) * m + i for i in range(m)]
        # a pair meets where it is nearest, and only if it is near enough to be among the k
        once = (F.least(*per) if m > 1 else per[0]) == radius * m + F.col("s")
        met = reduce(DataFrame.unionByName, parts).join(index.hint("merge"), ["s", "v"]).where(once & (F.bit_count(apart) <= F.col("limit")))
        found = met.select("q", "code", F.bit_count(apart).alias("d")).join(heads.hint("merge"), "code").select("q", "code", "d", "i", "c")
        # of equal distance, codes are kept by their smallest id
        pool = found if best is None else found.unionByName(best)
        ranked = pool.withColumns({"r": F.row_number().over(near), "sum": F.sum("c").over(near)}).where(F.col("r") <= k)
        ranked = stored(ranked, "nearest")
        covered = radius * m + segments[-1]
        limits = ranked.groupBy("q").agg(F.min(F.when(F.col("sum") >= k, F.col("d"))).alias("limit"))
        now = open_.select("q").join(limits, "q", "left")
        now = stored(now.select("q", F.coalesce("limit", F.lit(BITS)).alias("limit"), F.coalesce(F.col("limit") <= covered, F.lit(False)).alias("done")), "open")
        kept = ranked.select("q", "code", "d", "i", "c")
        closed.append(kept.join(now.where("done"), "q", "left_semi"))
        open_ = now.where("not done").select("q", "limit")
        best = kept.join(open_, "q", "left_semi")
        if open_.isEmpty():
            break
    best = reduce(DataFrame.unionByName, closed, best).select("q", "code", "d")
    each = best.join(entries.hint("merge"), "code").select("q", "d", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy("d", "id")
    top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # rows of one query code may be many: their answers are broadcast, or spread
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.col("d").alias("distance")))).alias("near"))
    sizes = clean[1].groupBy(F.col("code").alias("q")).agg(F.count("*").alias("_n"))
    answers = stored(lists.join(sizes, "q").withColumnRenamed("q", "code"), "answers")
    ask = clean[1].withColumnRenamed("id", "query_id")
    out = with_group_values(ask, answers, ["code"], "_n", clean[1].count())
    return out.select("query_id", F.explode("near").alias("e")).select("query_id", "e.*")
