"""Positions and running totals over a whole table without a one-task window.

Rows are cut into ordered ranges; totals per range are tiny, so their running
sum gives every range its offset, and the remaining work is one window per
range.  The range of a row depends on its own values only, so recomputed
tasks agree with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.sources.workspace import new_dir

RANGE_ROWS = 1_000_000  # rows of a sorted range
STEP = 32
CHUNK = 1024


def range_count(df: DataFrame) -> int:
    """32 ranges on small sessions, 1024 where there are many shuffle tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return STEP if tasks <= STEP else STEP * STEP


def range_of(df: DataFrame, order: str) -> Column:
    """Ordered range number of each row's numeric ``order`` value.

    The cuts are approximate quantiles, fetched once as a scalar subquery.  The
    number of cuts below a value is its place among them, found first among
    every 32nd cut and then among the cuts between two of those.
    """
    n = range_count(df)
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(order, shares, F.lit(max(1000, 4 * n))).alias("fine"))
    if n > STEP:
        every = F.filter("fine", lambda _, i: i % STEP == STEP - 1)
        cuts = cuts.select(F.struct("fine", every.alias("coarse")).alias("cuts"))
    found = cuts.scalar()
    value = F.col(order)

    def place(sorted_cuts):
        return F.array_position(F.sort_array(F.array_append(sorted_cuts, value)), value).cast("int") - 1

    if n <= STEP:
        return F.coalesce(place(found), F.lit(0))
    block = F.coalesce(place(found["coarse"]), F.lit(0))
    within = place(F.slice(found["fine"], block * STEP + 1, F.lit(STEP - 1)))
    return block * STEP + F.coalesce(within, F.lit(0))


def with_offsets(ranged: DataFrame, group: Sequence[str], totals: dict[str, Column], descending: bool = False) -> DataFrame:
    """Add ``_before_<name>``: the total of all earlier ranges of the group.

    ``ranged`` carries a column ``_range`` with a bounded number of values.
    """
    per_range = ranged.groupBy(*group, "_range").agg(*[c.alias(f"_t_{k}") for k, c in totals.items()])
    order = F.desc("_range") if descending else F.asc("_range")
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in totals],
    )
    return ranged.join(offsets, [*group, "_range"])


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder, made once."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: Sequence[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with their ``_range``: sorted ranges of some ``rows`` rows, as many as the table needs.

    The rows are written, counted and written again by range, so that a range keeps
    its rows whatever is computed from it later.
    """
    whole = kept(df, "rows")
    n = max(1, -(-whole.count() // rows))
    return kept(whole.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def with_position(df: DataFrame, order: str | Sequence[Column], out: str = "position", rows: int = RANGE_ROWS) -> DataFrame:
    """Zero-based position of each row by a column, or several, of distinct values."""
    keys = [F.col(order).asc()] if isinstance(order, str) else list(order)
    placed = with_offsets(in_ranges(df, keys, rows), [], {"n": F.count("*")})
    inside = Window.partitionBy("_range").orderBy(*keys)
    position = F.col("_before_n") + F.row_number().over(inside) - 1
    return placed.withColumn(out, position.cast("bigint")).drop("_range", "_before_n")


def with_hash_position(df: DataFrame, key: str, group: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Zero-based position by a uniformly distributed hex ``key``, per group.

    The first three digits of the key cut every group into 4096 ranges, so even
    a group with most of the rows is ranked by many tasks.
    """
    ranged = df.withColumn("_range", F.substring(key, 1, 3))
    placed = with_offsets(ranged, list(group), {"n": F.count("*")})
    inside = Window.partitionBy(*group, "_range").orderBy(key)
    position = F.col("_before_n") + F.row_number().over(inside) - 1
    return placed.withColumn(out, position.cast("bigint")).drop("_range", "_before_n")


def running_totals(df: DataFrame, order: str, sums: Sequence[str], descending: bool = True) -> DataFrame:
    """Add ``cum_<name>``: the running sum of each column by a distinct ``order``."""
    ranged = df.withColumn("_range", range_of(df, order))
    placed = with_offsets(ranged, [], {s: F.sum(s) for s in sums}, descending)
    by = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    for s in sums:
        placed = placed.withColumn(f"cum_{s}", F.col(f"_before_{s}") + F.sum(s).over(inside))
    return placed.drop("_range", *[f"_before_{s}" for s in sums])


def with_neighbour(df: DataFrame, group: Sequence[str], order: str, cols: dict[str, str], chunk: int = CHUNK, ahead: bool = True) -> DataFrame:
    """Values of the next (or previous) row within a group.

    ``cols`` maps source columns to output names.  Groups are cut by ``order``
    into chunks of at most ``chunk`` consecutive values, so no task holds more
    of a group than that; only each chunk's edge row travels to the next chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    edge_value = F.min_by if ahead else F.max_by
    edges = chunked.groupBy(*group, "_chunk").agg(edge_value(F.struct(*cols), order).alias("_edge"))
    # which chunk is next door: one small row per chunk
    per_group = Window.partitionBy(*group).orderBy("_chunk")
    move = F.lead if ahead else F.lag
    doors = chunked.select(*group, "_chunk").distinct()
    doors = doors.withColumn("_from", move("_chunk").over(per_group))
    brought = doors.where("_from is not null").join(
        edges.withColumnRenamed("_chunk", "_from"), [*group, "_from"]
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(order)
    local = chunked.withColumn("_near", move(F.struct(*cols)).over(inside))
    joined = local.join(brought.drop("_from"), [*group, "_chunk"], "left")
    value = F.coalesce("_near", "_edge")
    for src, name in cols.items():
        joined = joined.withColumn(name, value[src])
    return joined.drop("_chunk", "_near", "_edge")


def with_last_seen(df: DataFrame, group: Sequence[str], order: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """The last non-null ``value`` at or before each row of a group.

    Cut into chunks like :func:`with_neighbour`: a chunk hands on its last
    value, later chunks that begin without one receive it.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    edges = chunked.groupBy(*group, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_carried")
    )
    # the nearest earlier chunk with a value: one small row per chunk
    earlier = (
        Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    filled = F.when(F.col("_carried").isNotNull(), F.col("_chunk"))
    doors = edges.withColumn("_from", F.last(filled, ignorenulls=True).over(earlier)).drop("_carried")
    brought = doors.where("_from is not null").join(
        edges.withColumnRenamed("_chunk", "_from"), [*group, "_from"]
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    joined = local.join(brought.drop("_from"), [*group, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce("_local", "_carried")).drop("_chunk", "_local", "_carried")
