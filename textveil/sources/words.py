"""Word lists and deny lists from text files or tables."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from textveil.functions.text import strip_ws
from textveil.operators.dictionary import clean_word_list


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of a text file, or None when there is no such file."""
    try:
        return spark.read.text(path)
    except AnalysisException:
        warnings.warn(f"word list not found: {path}", stacklevel=3)
        return None


def read_word_list(
    spark: SparkSession,
    path: str,
    min_len: int = 1,
    exclude: DataFrame | None = None,
    comments: str | None = None,
    missing_ok: bool = True,
) -> DataFrame:
    """Distinct words of a file with one word per line.

    A missing file gives an empty list and a warning, or an error if
    ``missing_ok`` is false.
    """
    lines = _lines(spark, path)
    if lines is None:
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], "word string")
    if comments:
        lines = lines.where(~strip_ws("value").startswith(comments))
    return clean_word_list(lines, "value", min_len, exclude)


def read_safe_words(spark: SparkSession, path: str) -> DataFrame:
    """Safe words: stripped lines that are neither blank nor comments."""
    lines = _lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], "word string")
    word = strip_ws("value")
    return lines.select(word.alias("word")).where("word <> ''").where(~F.col("word").startswith("#")).distinct()


def parse_deny_list(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deny-list entries of pasted text, one row each, in order."""
    lines = df.select(*keep, F.posexplode(F.split(col, "\n")).alias("ord", "term"))
    return lines.withColumn("term", strip_ws("term")).where("term <> ''")


def read_deny_list(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, term)`` of a deny-list file; duplicates and order are kept.

    A deny list is configuration that people type, so one file is one row
    here; a missing or unreadable file is an empty list.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        warnings.warn(f"deny list not found: {path}", stacklevel=2)
        return spark.createDataFrame([], "ord int, term string")
    return parse_deny_list(whole, "value").select("ord", "term")


def write_deny_list(df: DataFrame, path: str) -> bool:
    """Write the entries in order, one per line; tells whether it worked."""
    try:
        df.orderBy("ord").select("term").coalesce(1).write.mode("overwrite").text(path)
        return True
    except Exception:  # the caller gets the flag, as with any failed save
        return False
