"""Turning array columns into rows without computing them twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def unpack(df: DataFrame, array: str, keep: Sequence[str] = (), pos: str | None = None) -> DataFrame:
    """One row per struct in an array column, with the struct's fields.

    From a plain explode of a column the optimizer derives a check of the
    array's size and pushes it below the projection that computes the array,
    which then runs twice or more.  The outer form with a filter on the
    position afterwards gives the same rows and computes it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", "_e")).where("_pos is not null")
    numbered = [F.col("_pos").alias(pos)] if pos else []
    return rows.select(*keep, *numbered, "_e.*")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but the column is computed here and only once.

    The optimizer copies expressions into those that use them.  A copy of a long one
    inside a batch function's arguments costs time, and with many lambdas the function
    is not even found again.  A generator of one row per row keeps them apart, and
    filters on other columns still pass it.
    """
    one = df.withColumn("_settled", F.explode(F.array(F.struct(value.alias("v")))))
    return one.withColumn(name, F.col("_settled.v")).drop("_settled")
