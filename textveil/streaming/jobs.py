"""The same expressions on streams: rewriting, auditing, skipping, resuming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from textveil.functions.text import is_blank
from textveil.operators.anonymize import anonymize
from textveil.operators.scrub import scrub
from textveil.sources.words import read_deny_list


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append everything that is available now, then stop.

    Offsets and the sink's log are in ``checkpoint``: started again with the
    same folders, the job goes on after the last finished batch.
    """
    return (
        df.writeStream.format(format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def scrub_stream(df: DataFrame, txt: str = "text", names: Sequence[str] = (), cities: Sequence[str] = (), **options) -> DataFrame:
    """Scrub a stream, with lists (or frames) of up to a million words.

    Lists beyond what executors can hold need :func:`rewrite_batches`.
    """
    return scrub(df, txt, names, cities, **options)


def anonymize_stream(df: DataFrame, txt: str = "text", **options) -> DataFrame:
    return anonymize(df, txt, **options)


def rewrite_batches(df: DataFrame, rewrite: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``rewrite(batch)`` of each micro-batch, as Parquet below ``path``.

    A batch is an ordinary frame, so lists of any size work.  Its folder carries its
    number and is overwritten when the batch is tried again, so no row comes twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rewrite(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def anonymize_with_reload(df: DataFrame, deny_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, txt: str = "text", **options) -> StreamingQuery:
    """Anonymize each micro-batch with the deny list as it is at that moment."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        terms = read_deny_list(batch.sparkSession, deny_path).select(F.col("term").alias("word"))
        sink(anonymize(batch, txt, deny_terms=terms, **options), batch_id)

    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def anonymize_as_of(df: DataFrame, ts: str, versions: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, txt: str = "text", **options) -> StreamingQuery:
    """Anonymize each row with the deny list in force at its event time ``ts``.

    ``versions`` gives ``(valid_from, term)`` and is called for each micro-batch, so a
    version that is added takes effect with the next one; rows that come late still
    meet the list of their own time.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(anonymize(batch, txt, deny_as_of=(ts, versions()), **options), batch_id)

    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on ``ts``; watermarks need a timestamp with time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_audit(df: DataFrame, ts: str, entity_type: str, size: str, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Findings per entity type and tumbling or sliding window."""
    kind = dict(df.dtypes)[ts]
    source = with_event_time(df, ts, late) if late else df
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = source.groupBy(window.alias("w"), F.col(entity_type).alias("entity_type")).agg(F.count("*").alias("n"))
    start, end = F.col("w.start").cast(kind), F.col("w.end").cast(kind)
    return counts.select(start.alias("window_start"), end.alias("window_end"), "entity_type", "n")


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the groups that each micro-batch has changed, those still open included.

    Append mode holds a window back until the watermark has passed its end, so those
    open when the stream ends never come.  Here every state of a window is written,
    with the number of its batch; :func:`latest_states` picks the last one.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_states(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written state of each group, with the other columns of that state."""
    states = spark.read.parquet(path)
    values = [c for c in states.columns if c not in (*keys, "batch_id")]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return last.select(*keys, "_v.*")


def session_audit(df: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Findings per user and session; a session ends after ``gap`` without any."""
    kind = dict(df.dtypes)[ts]
    source = with_event_time(df, ts, late) if late else df
    counts = source.groupBy(F.session_window(ts, gap).alias("w"), F.col(user).alias("user_id")).agg(F.count("*").alias("n"))
    start, end = F.col("w.start").cast(kind), F.col("w.end").cast(kind)
    return counts.select("user_id", start.alias("session_start"), end.alias("session_end"), "n")


def text_digest(txt) -> Column:
    return F.sha2(F.col(txt) if isinstance(txt, str) else txt, 256)


def skip_seen(df: DataFrame, ts: str, txt: str = "text", horizon: str = "1 day") -> DataFrame:
    """Drop texts already seen within ``horizon`` of event time."""
    keyed = with_event_time(df.where(~is_blank(txt)).withColumn("text_hash", text_digest(txt)), ts, horizon)
    return keyed.dropDuplicatesWithinWatermark(["text_hash"]).drop("text_hash")


def keep_large_state(spark: SparkSession) -> None:
    """Let streams started from now on keep their state in RocksDB, on executors' disks and in the checkpoint."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def skip_seen_for_good(df: DataFrame, txt: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Drop texts that were ever seen, whatever their event times.

    The state is one 32-byte digest for each distinct text, keyed by it, and no
    watermark removes any: it grows with the distinct texts, spread over all tasks, so
    start such a stream after :func:`keep_large_state`.  ``known`` is a table of texts
    that count as seen from the beginning, matched by digest.  Blank and null texts
    are dropped.  Of equal texts in one micro-batch any one row stays.
    """
    fresh = df.where(~is_blank(txt)).withColumn("_digest", F.unhex(text_digest(txt)))
    if known is not None:
        seen = known.where(~is_blank(txt)).select(F.unhex(text_digest(txt)).alias("_digest")).distinct()
        fresh = fresh.join(seen, "_digest", "left_anti")
    return fresh.dropDuplicates(["_digest"]).drop("_digest")
