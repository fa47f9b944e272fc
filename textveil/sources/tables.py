"""CSV, JSON and text readers and writers with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from textveil.constants import DATASET_NAME, SCORES_NAME, SCRUB_RULES
from textveil.functions.text import as_col
from textveil.operators.ranking import with_position

LABELLED = "text string, label string, source string, source_text string"
ANSWERS = "exercise string, text string, question string, answer string, length_instruction string"
ENGLISH = "text string, class string"
TRAINING = "text string, label int"
EVALUATION = "text string, label string, category string"

# quotes are doubled inside quoted fields, which may span lines
_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
# no field has this value, so an explicit empty one is not taken for a missing one
_NO_VALUE = "\u0000"
_WHOLE, _CLOSES, _INSIDE, _OPENS = range(4)


def read_labelled(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """A CSV table with header; quoted fields may hold newlines.

    Missing fields are null, quoted empty ones are empty.  A file is read by as many
    tasks as it has splits.  Its lines' quotes are counted split by split; whether a
    split begins inside a quoted field is the parity of all quotes before it.  Only
    records that cross from one split to the next are put together by their file.
    Columns go by position; a header with other names is an error.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("odd", quotes % 2 == 1)
    # one small row a split
    parity = counted.groupBy("file", "block").agg(F.count_if("odd").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parity.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # the splits of a job are known to its driver, so their parities may be, too
    placed = counted.join(F.broadcast(starts), ["file", "block"])
    parts = placed.mapInArrow(_records, "text string, file string, block bigint, kind int, first boolean")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    torn = parts.where(F.col("kind") != _WHOLE).withColumn("record", F.count_if(F.col("kind") == _OPENS).over(order))
    joined = torn.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("p"), F.bool_or("first").alias("first")
    )
    mended = joined.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "first")
    records = parts.where(F.col("kind") == _WHOLE).select("text", "first").unionByName(mended)
    records = records.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
    return _parsed(records, schema)


def _parsed(records: DataFrame, schema: str) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    options = {"quote": '"', "escape": '"', "nullValue": _NO_VALUE, "emptyValue": ""}
    head = F.from_csv("text", F.lit(", ".join(f"_c{i} string" for i in range(len(names)))), options)
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & head[f"_c{i}"].eqNullSafe(F.lit(name))
    wrong = F.raise_error(F.concat(F.lit(f"expected the columns {', '.join(names)}, found "), F.col("text")))
    rows = records.where(F.when(F.col("first"), F.when(same, False).otherwise(wrong.cast("boolean"))).otherwise(True))
    return rows.select(F.from_csv("text", F.lit(schema), options).alias("r")).select("r.*")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task's splits, whole ones and the two torn ends of each split.

    Lines come in their order, with the parity of quotes before their split.
    """
    split, held, inside, torn, begun = None, [], False, False, False

    def out(texts: list[str], kind: int, first: int) -> pa.RecordBatch:
        n = len(texts)
        cols = [pa.array(texts, pa.string()), pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([i < first for i in range(n)])]
        return pa.RecordBatch.from_arrays(cols, ["text", "file", "block", "kind", "first"])

    def rest() -> list[pa.RecordBatch]:
        if not held:
            return []
        first = int(split[1] == 0 and not begun and not torn)
        return [out(["\n".join(held)], _INSIDE if torn else _OPENS, first)]

    for batch in batches:
        lines, odd = batch.column("value").to_pylist(), batch.column("odd").to_numpy(zero_copy_only=False)
        block, files = batch.column("block").to_numpy(), batch.column("file").dictionary_encode()
        code = files.indices.to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (code[1:] != code[:-1]), [True]))) if len(lines) else []
        for i, j in zip(edge[:-1], edge[1:]):
            here = (files.dictionary[code[i]].as_py(), int(block[i]))
            if here != split:
                yield from rest()
                split, held, begun = here, [], False
                inside = torn = bool(batch.column("inside")[i].as_py())
            open_after = (np.cumsum(odd[i:j]) + inside) % 2 == 1
            texts, at = [], int(i)
            for end in (i + np.flatnonzero(~open_after)).tolist():
                texts.append("\n".join([*held, *lines[at : end + 1]]) if held or end > at else lines[end])
                held, at = [], end + 1
            held = [*held, *lines[at:j]]
            inside = bool(open_after[-1])
            if texts and torn:
                yield out(texts[:1], _CLOSES, 0)
                texts, torn, begun = texts[1:], False, True
            if texts:
                yield out(texts, _WHOLE, int(split[1] == 0 and not begun))
                begun = True
    yield from rest()


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""', "nullValue": ""}
    df.write.mode(mode).options(**_CSV, **options, lineSep="\n").csv(path)


def append_examples(df: DataFrame, path: str, format: str = "csv") -> None:
    """Append examples to a table; each file carries its own header."""
    if format == "csv":
        _write_csv(df, path, "append")
    else:
        df.write.mode("append").format(format).save(path)


def write_scores(df: DataFrame, scores: Column | str, root: str, name: str) -> str:
    """The input columns and ``hypothesis_score``, named by data set."""
    path = f"{root}/" + SCORES_NAME.format(name=name)
    _write_csv(df.withColumn("hypothesis_score", as_col(scores)), path, "overwrite")
    return path


def write_training_set(df: DataFrame, path: str, format: str = "csv") -> None:
    if format == "csv":
        _write_csv(df, path, "overwrite")
    else:
        df.write.mode("overwrite").format(format).save(path)


def read_exercises(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Exercise trees as text in ``tree``: one JSON document per file, or per line."""
    return spark.read.text(path, wholetext=not per_line).select(F.col("value").alias("tree"))


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``(position, value)`` of a text table's lines, by file and then as they stand there."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    order = [F.asc("_file"), F.asc("_block"), F.asc("_line")]
    return with_position(lines, order).select("position", "value")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def dataset_path(root: str, dataset_id: str, mode: str) -> str:
    return f"{root}/" + DATASET_NAME.format(dataset_id=dataset_id, mode=mode)


def export_rules(spark: SparkSession, names: DataFrame, cities: DataFrame, root: str, rules: Sequence[tuple[str, str]] = tuple(SCRUB_RULES)) -> None:
    """Rules as one JSON document, word lists sorted, one word per line."""
    config = spark.range(1).select(F.to_json(rules_record(rules), {"pretty": "true"}).alias("value"))
    config.coalesce(1).write.mode("overwrite").text(f"{root}/pii_config")
    for df, name in ((names, "deny_names"), (cities, "deny_cities")):
        df.select("word").distinct().orderBy("word").write.mode("overwrite").text(f"{root}/{name}")


def rules_record(rules: Sequence[tuple[str, str]] = tuple(SCRUB_RULES)) -> Column:
    return F.struct(
        F.array(
            *[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in rules]
        ).alias("regex_rules"),
        F.struct(F.lit("deny_names.txt").alias("PERSON"), F.lit("deny_cities.txt").alias("LOCATION")).alias("deny_list_files"),
    )


# --- request and response records -------------------------------------------

def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests with ``text`` and a ``reject`` reason, null for valid ones."""
    parsed = df.withColumn("_r", F.from_json(body, "text string, entries array<string>"))
    text = F.col("_r.text")
    reason = (
        F.when(F.get_json_object(body, "$").isNull(), "malformed JSON")
        .when(text.isNull(), "text is required")
        .when(F.length(text) < 1, "text is empty")
    )
    return parsed.withColumn("text", text).withColumn("entries", F.col("_r.entries")).withColumn("reject", reason).drop("_r")


def to_responses(df: DataFrame, result: str = "result", out: str = "body") -> DataFrame:
    """The result struct as a JSON string."""
    return df.withColumn(out, F.to_json(F.col(result)))

