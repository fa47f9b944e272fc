"""Helpers on DataFrames that the operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textveil.sources.workspace import new_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Workers begin with the driver's PYTHONPATH, not with its sys.path.  On a
    cluster the package is installed or sent with --py-files, and this adds a
    path that changes nothing.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let Spark hand texts to Python workers some megabytes at a time, not ten thousand rows.

    Both sides hold a whole batch, and the executor's buffers double as they grow.  A
    session that sets its own size of batches keeps it.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, "2m")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the folder that all executors share.

    It cuts the lineage: what is written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: str | Column) -> Column:
    """How many words a text has; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_hash(*cols: str | Column) -> Column:
    """A number in (0, 1) that depends on the values only."""
    h = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of the keys, null being equal to null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def with_group_values(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, n_rows: int, share: int = 1000) -> DataFrame:
    """Give each row the values of its group, however many rows one group has.

    ``groups`` has one row per key and in ``size`` the rows of the group.  Fewer
    than ``share`` groups can have a ``share``-th of all rows or more, so these
    are broadcast; only rows of the others move.  Rows without a group get nulls.
    """
    values = [c for c in groups.columns if c not in keys]
    least = max(1.0, n_rows / share)
    renamed = [F.col(k).alias(f"_k_{k}") for k in keys]
    hot = groups.where(F.col(size) >= least).select(*renamed, *values, F.lit(True).alias("_hot"))
    cold = groups.where(F.col(size) < least).select(*renamed, *values)

    def match(side: DataFrame) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & rows[k].eqNullSafe(side[f"_k_{k}"])
        return on

    if cold.isEmpty():
        return rows.join(F.broadcast(hot), match(hot), "left").select(*rows.columns, *values)
    first = rows.join(F.broadcast(hot), match(hot), "inner").select(*rows.columns, *values)
    others = rows.join(F.broadcast(hot), match(hot), "left_anti")
    rest = others.join(cold, match(cold), "left").select(*rows.columns, *values)
    return first.unionByName(rest)
