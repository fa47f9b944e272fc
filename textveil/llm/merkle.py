"""Merkle manifest of a table: a digest per row, per group and for the whole, with proofs.

Leaves are numbered by group and key.  At each level every node sends its digest
to the computed indices of its siblings, an equijoin of the level with itself
(slots shifted by 1 to fanout - 1), and the rows of slot zero, which then know
their whole run, emit the parents.  The roots of the groups make a tree of their
own.  A leaf's path is the slot and the siblings at each level: joined top-down,
a level's nodes with their parents' paths, so no level is ever in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.llm.frames import stored, with_group_values

FANOUT = 16
BYTES = 32
PATH = "array<struct<slot:int,siblings:binary>>"
RANGE_ROWS = 1_000_000  # rows of one sorted range


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated text parts."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(c: str | Column) -> Column:
    """A value that cannot run into its neighbours: its UTF-8 length and itself, ``-`` for null."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    return digest(*[field(c) for c in columns])


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``idx``, the 0-based place of each row in its group, and ``size``, the group's rows.

    Null values come first.  Rows are cut into sorted ranges of some ``range_rows``
    rows, whatever the sizes of the groups; equal rows may be in several ranges.
    """
    n = max(1, -(-rows.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(n, *keys, F.col("_salt")).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    # one small row for each range of a group
    of_group = Window.partitionBy(*[F.col(c) for c in group])
    earlier = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range", *group).agg(F.count("*").alias("_n")).select(
        F.col("_range").alias("_r"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(of_group).alias("size"),
    )
    on = F.col("_range") == F.col("_r")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy("_range", *group).orderBy(*keys[len(group) :], F.col("_salt"))
    placed = ranged.join(parts, on).withColumn("idx", F.col("_before") + F.row_number().over(inside) - 1)
    return placed.select(*rows.columns, F.col("idx").cast("bigint").alias("idx"), F.col("size").cast("bigint").alias("size"))


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add ``slot`` and ``siblings``: the digests of the others of a node's run, in their order.

    ``nodes`` has tree, idx and digest.
    """
    slot = F.col("idx") % fanout
    sent = nodes.select("tree", slot.cast("int").alias("_slot"), (F.col("idx") - slot).alias("_run"), F.col("digest").alias("_digest"))
    sent = sent.withColumn("_shift", F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))))
    target = F.col("_run") + (F.col("_slot") + F.col("_shift")) % fanout
    sent = sent.select(F.col("tree").alias("_tree"), target.alias("_target"), "_slot", "_digest")
    met = nodes.join(sent, (nodes["tree"] == sent["_tree"]) & (nodes["idx"] == sent["_target"]), "left")
    own = [c for c in nodes.columns if c not in ("tree", "idx")]
    heard = F.sort_array(F.collect_list(F.when(F.col("_slot").isNotNull(), F.struct("_slot", "_digest"))))
    runs = met.groupBy("tree", "idx").agg(*[F.first(c).alias(c) for c in own], heard.alias("_heard"))
    joined = F.aggregate("_heard", F.lit(b""), lambda acc, x: F.concat(acc, x["_digest"]))
    return runs.select("tree", "idx", *own, slot.cast("int").alias("slot"), joined.alias("siblings"))


def fold(start: Column, slot: Column, siblings: Column) -> Column:
    """The parent's digest of a node whose digest (as hex text) may have changed."""
    left = siblings.substr(F.lit(1), slot * BYTES)
    right = siblings.substr(slot * BYTES + 1, F.length(siblings))
    return F.sha2(F.concat(as_text(left), start, as_text(right)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and a path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: fold(acc, x["slot"], x["siblings"]))


def proof(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda x: as_text(x["siblings"])), "")


def build(nodes: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The stored levels of trees of at most ``most`` leaves; ``nodes`` has tree, idx, size, digest."""
    levels = []
    while most > 1:
        level = stored(with_siblings(nodes, fanout), f"level{len(levels)}")
        levels.append(level)
        parent = F.unhex(fold(as_text(F.col("digest")), F.col("slot"), F.col("siblings")))
        # a tree of one node has its root
        nodes = level.where((F.col("slot") == 0) & (F.col("size") > 1)).select(
            "tree", (F.col("idx") / fanout).cast("bigint").alias("idx"), F.ceil(F.col("size") / fanout).cast("bigint").alias("size"), parent.alias("digest")
        )
        most = -(-most // fanout)
    last = nodes.withColumns({"slot": F.lit(0), "siblings": F.lit(b"")})  # one node a tree
    return [*levels, stored(last, f"level{len(levels)}")]


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """tree and digest of each tree's last node."""
    out = None
    for level in levels:
        found = level.where("size = 1").select("tree", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def paths(levels: Sequence[DataFrame], above: DataFrame, keep: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """``path`` of every node of the lowest level, as far as ``above`` (tree, path, further columns) leads."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    step = F.array(F.struct("slot", "siblings"))
    below = None
    for i, level in reversed(list(enumerate(levels))):
        own = ["tree", "idx", *(keep if i == 0 else [])]
        ends = level.where("size = 1").select(*own).join(above, "tree")
        if below is not None:
            parents = below.withColumnRenamed("idx", "_parent")
            inner = level.where("size > 1").withColumn("_parent", (F.col("idx") / fanout).cast("bigint")).join(parents, ["tree", "_parent"])
            ends = ends.unionByName(inner.select(*own, F.concat(step, F.col("path")).alias("path"), *more))
        below = ends
    return below


class Manifest(NamedTuple):
    root: str | None  # hex; null for an empty table
    leaves: DataFrame  # row (the columns given), digest, path, subroot (binary)


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Manifest:
    """Digests of each group of ``rows`` and of the whole, with each row's path to the root.

    ``rows`` has the binary digests of its rows in ``leaf``.  Leaves ascend by
    ``order`` within their group, groups by their value; null is first in both, and
    rows of equal order come by digest.  Repeated rows are leaves of their own; an
    empty table has no leaves and no root.
    """
    if fanout < 2:
        raise ValueError("a fanout of 2 or more is needed")
    leaves = stored(rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), F.struct(*rows.columns).alias("_row")), "leaves")
    placed = numbered(leaves, ["_group"], ["_order", "digest"], range_rows)
    groups = leaves.groupBy("_group").agg(F.count("*").alias("size"))
    groups = stored(numbered(groups.withColumnRenamed("size", "rows"), [], ["_group"], range_rows), "groups")
    n_groups, most = groups.agg(F.count("*"), F.max("rows")).first()
    if not n_groups:
        nothing = F.lit(None)
        return Manifest(None, leaves.select(F.col("_row").alias("row"), "digest", nothing.cast(PATH).alias("path"), nothing.cast("binary").alias("subroot")))
    trees = groups.select("_group", "rows", F.col("idx").alias("tree"))
    nodes = with_group_values(placed, trees, ["_group"], "rows", leaves.count()).select("tree", "idx", "size", "digest", "_row")
    levels = build(nodes, most, fanout)
    subroots = roots(levels).select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_groups).cast("bigint").alias("size"), "digest")
    top = build(subroots, n_groups, fanout)
    (root,) = roots(top).select(as_text(F.col("digest"))).first()
    start = top[-1].select("tree", F.array().cast(PATH).alias("path"))
    above = paths(top, start, ["digest"], fanout).select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"))
    out = paths(levels, above, ["digest", "_row"], fanout)
    return Manifest(root, out.select(F.col("_row").alias("row"), "digest", "path", "subroot"))
