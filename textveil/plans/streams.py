"""Queries: the stream jobs, run over what is available, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.text import mask_numbers, norm_tokens, squash_ws
from textveil.operators import anonymize as an
from textveil.operators import dictionary as dic
from textveil.operators.ranking import kept
from textveil.plans import corpus as co
from textveil.plans.registry import query, table
from textveil.sources.workspace import new_dir
from textveil.streaming import jobs


def incoming(spark, sf, name):
    """A given table, a file or a folder of files, as a file stream."""
    schema = table(spark, sf, name).schema
    # as a pattern the path may also name a file, which a stream's plain path may not
    return jobs.read_stream(spark, f"{sf}/{name}[.]parquet", schema)


def finish(df, name):
    """Run a stream to its end and read what it wrote."""
    spark = df.sparkSession
    out, state = new_dir(spark, name), new_dir(spark, f"{name}-state")
    jobs.write_stream(df, out, state).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(
    "r1_stream_scrub",
    rf"SELECT doc_id, regexp_replace({co.sql_squash(co.sql_rules())}, '\p{{Nd}}{{3,}}', '[NUM]', 'g') AS text FROM documents",
)
def r1(spark, sf):
    done = jobs.scrub_stream(incoming(spark, sf, "documents").select("doc_id", "text"))
    return finish(done, "scrubbed")


@query(
    "r1_stream_anonymize",
    f"SELECT doc_id, {co.sql_replace(co.sql_replace('text', co.RE2_RULES['EMAIL'], '<EMAIL>'), co.ZIP_RE2, '<PLZ>')} AS anonymized_text FROM documents",
)
def r1_anonymize(spark, sf):
    docs = incoming(spark, sf, "documents").select("doc_id", "text")
    done = jobs.anonymize_stream(docs, recognizers=[an.ZIP, an.EMAIL])
    return finish(done.select("doc_id", "result.anonymized_text"), "anonymized")


_ALL_WORDS = rf"""entries AS (
  SELECT DISTINCT regexp_replace(unnest(string_split({co.sql_squash('text')}, ' ')), '{co.NOT_WORD}', '', 'g') AS word FROM documents),
listed AS (SELECT word FROM entries WHERE length(word) >= 8 UNION SELECT 'entry' || i || 'x' FROM range(50000) t(i))"""


@query(
    "r1_stream_large_list",
    rf"""WITH {_ALL_WORDS}, ruled AS (SELECT doc_id, {co.sql_squash(co.sql_rules())} AS text FROM documents),
    t AS (SELECT doc_id, string_split(text, ' ') AS ts FROM ruled),
    u AS (SELECT doc_id, unnest(ts) AS tok, unnest(range(1, len(ts) + 1)) AS i FROM t),
    m AS (SELECT doc_id, i, CASE WHEN word IS NOT NULL THEN '[PERSON]' ELSE tok END AS tok
          FROM u LEFT JOIN listed ON word = regexp_replace(tok, '{co.NOT_WORD}', '', 'g'))
    SELECT doc_id, regexp_replace(string_agg(tok, ' ' ORDER BY i), '\p{{Nd}}{{3,}}', '[NUM]', 'g') AS text FROM m GROUP BY 1""",
)
def r1_large(spark, sf):
    """A stream with more than 50,000 names: all longer words of the documents and 50,000 others."""
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(norm_tokens(squash_ws("text")))).alias("word"))
    more = spark.range(50_000).select(F.concat(F.lit("entry"), F.col("id").cast("string"), F.lit("x")).alias("word"))
    # stored, since it is counted before it is fetched or joined
    listed = kept(words.where(F.length("word") >= 8).unionByName(more).distinct(), "listed")
    docs = incoming(spark, sf, "documents").select("doc_id", "text")
    held = dic.held_words(listed)
    if held is not None:
        return finish(jobs.scrub_stream(docs, names=held), "scrubbed")
    out, state = new_dir(spark, "scrubbed"), new_dir(spark, "scrubbed-state")
    jobs.rewrite_batches(docs, lambda batch: jobs.scrub_stream(batch, names=listed), out, state).awaitTermination()
    return spark.read.schema(docs.schema).parquet(out).select(*docs.columns)


def in_two_runs(df, part, name, start):
    """Run a stream job over ``df``, and again when the rows for which ``part`` holds have come.

    ``start`` takes the file stream and starts the job, always on the same folders.  So
    each part is a micro-batch of its own, of as many files as tasks have written.
    """
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    for rows in (df.where(~part), df.where(part)):
        rows.write.mode("append").parquet(path)
        start(jobs.read_stream(spark, path, df.schema)).awaitTermination()


def batch_sink(out, *columns):
    def sink(batch, batch_id):
        batch.select(*columns).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return sink


@query(
    "r2_stream_deny_reload",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '\b(?:the and|the|and)\b', '<INTERN>', 'g')
      ELSE regexp_replace(text, '\b(?:of|is)\b', '<INTERN>', 'g') END AS anonymized_text FROM documents""",
)
def r2(spark, sf):
    """Two micro-batches, each a run of its own; the list is replaced between them."""
    deny, out = new_dir(spark, "deny"), new_dir(spark, "reloaded")

    def write(*terms):
        spark.createDataFrame([(t,) for t in terms], "value string").coalesce(1).write.mode("overwrite").text(deny)

    keep = batch_sink(out, "doc_id", "result.anonymized_text")

    def sink(batch, batch_id):
        keep(batch, batch_id)
        write("of", "is")

    write("and", "the and", "the")
    docs, state = table(spark, sf, "documents").select("doc_id", "text"), new_dir(spark, "reload-state")
    in_two_runs(docs, F.col("doc_id") % 2 != 0, "parts", lambda stream: jobs.anonymize_with_reload(stream, deny, sink, state, recognizers=[]))
    return spark.read.parquet(out).drop("batch_id")


_VERSIONS = [("2024-01-05", ["and"]), ("2024-01-12", ["the and", "the"]), ("2024-01-20", ["of", "is", "entry"])]


@query(
    "r2_versioned_list",
    r"""WITH d AS (SELECT doc_id, text, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 720) HOUR AS moment FROM documents)
    SELECT doc_id, CASE WHEN moment < TIMESTAMP '2024-01-05' THEN text
      WHEN moment < TIMESTAMP '2024-01-12' THEN regexp_replace(text, '\band\b', '<INTERN>', 'g')
      WHEN moment < TIMESTAMP '2024-01-20' THEN regexp_replace(text, '\b(?:the and|the)\b', '<INTERN>', 'g')
      ELSE regexp_replace(text, '\b(?:of|is|entry)\b', '<INTERN>', 'g') END AS anonymized_text FROM d""",
)
def r2_versions(spark, sf):
    """Each row meets the list in force at its event time; the later micro-batch is full of late rows."""
    kept, out = new_dir(spark, "versions"), new_dir(spark, "as-of")
    rows = [(since, term) for since, terms in _VERSIONS for term in terms]
    versions = spark.createDataFrame(rows, "since string, term string")
    versions.select(F.to_timestamp("since").alias("valid_from"), "term").coalesce(1).write.parquet(kept)
    since = F.lit("2024-01-01").cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(since) + (F.col("doc_id") % 720) * 3_600_000_000)
    docs, state = table(spark, sf, "documents").select("doc_id", "text", at.alias("at")), new_dir(spark, "as-of-state")
    sink, listed = batch_sink(out, "doc_id", "result.anonymized_text"), lambda: spark.read.parquet(kept)
    in_two_runs(docs, F.col("doc_id") % 3 == 0, "parts", lambda stream: jobs.anonymize_as_of(stream, "at", listed, sink, state, recognizers=[]))
    return spark.read.parquet(out).drop("batch_id")


_TUMBLING = """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
  event_type AS entity_type, count(*) AS n FROM events GROUP BY 1, 2, 3"""


@query("r3_tumbling_audit", _TUMBLING)
def r3(spark, sf):
    return jobs.windowed_audit(table(spark, sf, "events"), "ts", "event_type", "1 hour", late=None)


@query(
    "r3_sliding_audit",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - unnest([INTERVAL '0 minutes', INTERVAL '30 minutes']) AS s FROM events)
    SELECT s AS window_start, s + INTERVAL '1 hour' AS window_end, event_type AS entity_type, count(*) AS n FROM w GROUP BY 1, 2, 3""",
)
def r3_sliding(spark, sf):
    return jobs.windowed_audit(table(spark, sf, "events"), "ts", "event_type", "1 hour", "30 minutes", late=None)


@query(
    "r3_session_audit",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def r3_session(spark, sf):
    return jobs.session_audit(table(spark, sf, "events"), "ts", "user_id", late=None)


@query(
    "r3_stream_audit",
    f"""WITH t AS ({_TUMBLING}) SELECT * FROM t WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
)
def r3_stream(spark, sf):
    """Append mode: a window is written once the watermark has passed its end."""
    counts = jobs.windowed_audit(incoming(spark, sf, "events"), "ts", "event_type", "1 hour")
    return finish(counts, "audit")


@query("r3_stream_all_windows", _TUMBLING)
def r3_all(spark, sf):
    """Two micro-batches, the windows still open at the end included."""
    out, state = new_dir(spark, "windows"), new_dir(spark, "windows-state")
    events = table(spark, sf, "events").select("ts", "event_type")
    middle = events.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).scalar()
    counted = lambda stream: jobs.windowed_audit(stream, "ts", "event_type", "1 hour")
    in_two_runs(events, F.unix_micros(F.col("ts").cast("timestamp")) > middle, "events", lambda stream: jobs.write_updates(counted(stream), out, state))
    return jobs.latest_states(spark, out, ["window_start", "window_end", "entity_type"])


@query("r4_stream_skip_seen", "SELECT DISTINCT user_id, event_type FROM events")
def r4(spark, sf):
    events = incoming(spark, sf, "events").withColumn("text", F.concat_ws(" ", "user_id", "event_type"))
    fresh = jobs.skip_seen(events, "ts", horizon="60 days")
    return finish(fresh.select("user_id", "event_type"), "fresh")


@query("r4_seen_for_good", "SELECT DISTINCT sha256(text) AS text_sha256, 2001 AS year FROM documents")
def r4_for_good(spark, sf):
    """All texts come again after 23 years, in a later run; none passes twice."""
    docs = table(spark, sf, "documents").select("text")
    years = docs.withColumn("ts", F.explode(F.array(*[F.lit(f"{y}-06-01").cast("timestamp") for y in (2001, 2024)])))
    out, state = new_dir(spark, "for-good"), new_dir(spark, "for-good-state")

    def start(stream):
        fresh = jobs.skip_seen_for_good(stream.withWatermark("ts", "1 day"))
        return jobs.write_stream(fresh.select(F.sha2("text", 256).alias("text_sha256"), F.year("ts").alias("year")), out, state)

    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind, None)
    jobs.keep_large_state(spark)
    try:
        in_two_runs(years, F.year("ts") == 2024, "years", start)
    finally:
        spark.conf.unset(kind) if before is None else spark.conf.set(kind, before)
    return spark.read.schema("text_sha256 string, year int").parquet(out)


@query("r5_stream_resume", "SELECT doc_id, regexp_replace(text, '\\p{Nd}{3,}', '[NUM]', 'g') AS text FROM documents")
def r5(spark, sf):
    """Started twice on the same folders; the second run finds nothing new."""
    out, state = new_dir(spark, "resumed"), new_dir(spark, "resumed-state")
    for _ in range(2):
        docs = incoming(spark, sf, "documents").select("doc_id", mask_numbers("text").alias("text"))
        jobs.write_stream(docs, out, state).awaitTermination()
    return spark.read.parquet(out)


