from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textveil.operators import anonymize as an
from textveil.operators.scrub import scrub
from textveil.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_scrub_resumes_without_repeating(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id bigint, text string"
    for batch in ([(1, "A123456789"), (2, "Weber")], [(3, "12345")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        stream = jobs.scrub_stream(jobs.read_stream(spark, src, schema), names=["Weber"])
        jobs.write_stream(stream, out, state).awaitTermination()
    rows = spark.read.parquet(out).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["[MEDICAL_ID]", "[PERSON]", "[NUM]"]


def test_deny_list_is_read_again(spark, tmp_path):
    src, state, deny = str(tmp_path / "in"), str(tmp_path / "state"), tmp_path / "deny.txt"
    schema, seen = "doc_id bigint, text string", []

    def sink(df, _):
        seen.extend(df.select("doc_id", "result.anonymized_text").orderBy("doc_id").collect())

    for i, terms in enumerate(["Eins", "Zwei"], 1):
        deny.write_text(terms, encoding="utf-8")
        spark.createDataFrame([(i, "Eins Zwei")], schema).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, src, schema)
        jobs.anonymize_with_reload(stream, str(deny), sink, state).awaitTermination()
    assert [tuple(r) for r in seen] == [(1, "<INTERN> Zwei"), (2, "Eins <INTERN>")]


def test_windows_drop_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, entity_type string"
    batches = [
        [(T0 + timedelta(minutes=m), "PERSON") for m in (1, 5, 65)],
        [(T0 + timedelta(minutes=130), "PERSON")],
        [(T0 + timedelta(minutes=2), "PERSON"), (T0 + timedelta(minutes=300), "PERSON")],
        [(T0 + timedelta(minutes=301), "PERSON")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        counts = jobs.windowed_audit(jobs.read_stream(spark, src, schema), "ts", "entity_type", "1 hour")
        jobs.write_stream(counts, out, state).awaitTermination()
    got = {r.window_start: r.n for r in spark.read.parquet(out).collect()}
    assert got == {T0: 2, T0 + timedelta(hours=1): 1, T0 + timedelta(hours=2): 1}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.repartition(3).write.parquet(src)
    stream = jobs.anonymize_stream(jobs.read_stream(spark, src, docs.schema), deny_terms=["the"])
    jobs.write_stream(stream.select("doc_id", F.to_json("result").alias("r")), out, state).awaitTermination()
    batch = an.anonymize(docs, deny_terms=["the"]).select("doc_id", F.to_json("result").alias("r"))
    assert spark.read.parquet(out).exceptAll(batch).count() == 0
    assert spark.read.parquet(out).count() == batch.count()


def test_seen_texts_are_skipped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, text string"
    for rows in ([(T0, "a"), (T0, "a"), (T0, " ")], [(T0 + timedelta(hours=1), "a"), (T0 + timedelta(hours=1), "b")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        fresh = jobs.skip_seen(jobs.read_stream(spark, src, schema), "ts")
        jobs.write_stream(fresh, out, state).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_sessions(spark):
    rows = [(T0 + timedelta(minutes=m), 1) for m in (0, 10, 60)] + [(T0, 2)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id int")
    got = sorted((r.user_id, r.n) for r in jobs.session_audit(df, "ts", "user_id", late=None).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_batches_take_large_lists(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, names = "doc_id bigint, text string", [f"Name{i}" for i in range(10_001)]
    spark.createDataFrame([(1, "Hallo Name7"), (None, "Hallo Name10000")], schema).write.parquet(src)
    stream = jobs.read_stream(spark, src, schema)
    jobs.rewrite_batches(stream, lambda b: scrub(b, names=names), out, state).awaitTermination()
    assert [r.text for r in spark.read.parquet(out).collect()] == ["Hallo [PERSON]"] * 2


def test_a_table_in_a_folder_of_files_is_streamed(spark, tmp_path):
    from textveil.plans import streams as st

    rows = spark.createDataFrame([(i, f"Nr {i}{i}{i}") for i in range(1, 7)], "doc_id bigint, text string")
    rows.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    done = st.r5(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in done] == [(i, "Nr [NUM]") for i in range(1, 7)]


def test_a_later_part_of_many_files_comes_whole(spark, tmp_path, monkeypatch):
    from textveil.plans import streams as st

    # in this order the first part is in fewer files than the second
    events = spark.range(0, 400, 1, 8).select((F.lit(T0) + F.make_interval(hours=F.col("id"))).alias("ts"), F.lit("x").alias("event_type"))
    part = F.col("ts") >= F.lit(T0 + timedelta(hours=60))
    out, state, sizes = str(tmp_path / "out"), str(tmp_path / "state"), []

    def start(stream):
        sizes.append(len(spark.read.parquet(str(tmp_path / "events")).inputFiles()))
        return jobs.write_updates(jobs.windowed_audit(stream, "ts", "event_type", "1 hour"), out, state)

    monkeypatch.setattr(st, "new_dir", lambda _, name: str(tmp_path / name))
    st.in_two_runs(events, part, "events", start)
    assert sizes[1] - sizes[0] > sizes[0] > 1  # many tasks have written, and will read, each part
    assert jobs.latest_states(spark, out, ["window_start", "window_end", "entity_type"]).count() == 400


def test_a_list_too_large_to_hold_is_looked_up_whole(spark, tmp_path, monkeypatch):
    from textveil.operators import dictionary
    from textveil.plans import all_queries

    words = [f"Wortlang{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    texts = [(i, f"{w}, kurz {words[-i]}. entry{i}x 1998") for i, w in enumerate(words)] + [(-1, ""), (-2, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def rows():
        found = all_queries()["r1_stream_large_list"](spark, str(tmp_path))
        return {r.doc_id: r.text for r in found.collect()}

    monkeypatch.setattr(dictionary, "MAX_BROADCAST_WORDS", 20_000)
    got = rows()
    assert got.pop(-1) == "" and got.pop(-2) is None
    assert len(got) == 600 and set(got.values()) == {"[PERSON] kurz [PERSON] [PERSON] [DATE_YEAR]"}
    monkeypatch.undo()
    assert {k: v for k, v in rows().items() if k >= 0} == got
