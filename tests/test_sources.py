import json

import pytest
from pyspark.sql import functions as F

from textveil.operators.dictionary import words_frame
from textveil.sources import tables as st
from textveil.sources import words as sw


def test_word_files(spark, tmp_path):
    (tmp_path / "safe.txt").write_text("# Kopf\nBach\n\n  Au \n", encoding="utf-8")
    (tmp_path / "namen.txt").write_text('"Meier"\nAbt\nBach\nEy\n\nAbt\n', encoding="utf-8")
    safe = sw.read_safe_words(spark, str(tmp_path / "safe.txt"))
    assert {r.word for r in safe.collect()} == {"Bach", "Au"}
    names = sw.read_word_list(spark, str(tmp_path / "namen.txt"), 3, safe)
    assert {r.word for r in names.collect()} == {"Meier", "Abt"}
    with pytest.warns(UserWarning):
        assert sw.read_word_list(spark, str(tmp_path / "orte.txt"), 4).count() == 0
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        sw.read_word_list(spark, str(tmp_path / "orte.txt"), missing_ok=False)


def test_deny_list_files(spark, tmp_path):
    (tmp_path / "deny.txt").write_text("B b\r\n\n A \nB b\n", encoding="utf-8")
    got = sw.read_deny_list(spark, str(tmp_path / "deny.txt")).orderBy("ord")
    assert [r.term for r in got.collect()] == ["B b", "A", "B b"]
    out = str(tmp_path / "out")
    assert sw.write_deny_list(got, out)
    assert [r.term for r in sw.read_deny_list(spark, out).orderBy("ord").collect()] == ["B b", "A", "B b"]
    with pytest.warns(UserWarning):
        assert sw.read_deny_list(spark, str(tmp_path / "none.txt")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "q" b', "SAFE", "s", ""), ("x\ny, z", "UNSAFE", "s", None), ("  pad  ", "SAFE", "s", "\\n")]
    df = spark.createDataFrame(rows, st.LABELLED)
    path = str(tmp_path / "set")
    st.append_examples(df, path)
    st.append_examples(df.limit(1), path)
    got = sorted(map(str, st.read_labelled(spark, path).collect()))
    assert got == sorted(map(str, df.collect() + df.limit(1).collect()))


def test_plain_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,source\n"eins, ""zwei""\ndrei",SAFE,synthetic\n', encoding="utf-8")
    schema = "text string, label string, source string"
    assert tuple(st.read_labelled(spark, str(tmp_path / "a.csv"), schema).first()) == ('eins, "zwei"\ndrei', "SAFE", "synthetic")


def test_export(spark, tmp_path):
    st.export_rules(spark, words_frame(spark, ["Ö", "b", "A"]), words_frame(spark, []), str(tmp_path))
    config = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "pii_config")).collect()))
    assert [r["name"] for r in config["regex_rules"]][0] == "MEDICAL_ID" and len(config["regex_rules"]) == 6
    assert config["deny_list_files"] == {"PERSON": "deny_names.txt", "LOCATION": "deny_cities.txt"}
    names = spark.read.text(str(tmp_path / "deny_names"))
    assert sorted(r[0] for r in names.collect()) == ["A", "b", "Ö"]


def test_requests(spark):
    rows = [('{"text": "hi"}',), ('{"text": ""}',), ("{}",), ("nope",), ('{"text": "x", "entries": ["a"]}',)]
    got = st.parse_requests(spark.createDataFrame(rows, "body string")).collect()
    assert [r.reject for r in got] == [None, "text is empty", "text is required", "malformed JSON", None]
    assert got[4].entries == ["a"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="label"):
        st.require_columns(spark.range(1), "id", "label")
    assert st.dataset_path("/x", "v2", "all") == "/x/german_safety_v2_all"


def test_score_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "text string, s double")
    path = st.write_scores(df, F.col("s"), str(tmp_path), "set")
    assert path.endswith("set_classification_scores")
    assert spark.read.option("header", True).csv(path).columns == ["text", "s", "hypothesis_score"]


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [("".join(rng.choice(['a', '"', "\n", ",", " ", "ä", "\r"]) for _ in range(rng.randrange(60))) + "x", f"l{i}", rng.choice(["", "s", None]), None) for i in range(800)]
    rows.append(("line\n" * 3000, "long", "s", ""))
    path = str(tmp_path / "one")
    st.append_examples(spark.createDataFrame(rows, st.LABELLED).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = st.read_labelled(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 15
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    usual = spark.read.schema(st.LABELLED).options(header=True, quote='"', escape='"', multiLine=True, lineSep="\n").csv(path)
    assert usual.count() == len(rows)


def test_other_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,etikett\na,b\n", encoding="utf-8")
    with pytest.raises(Exception, match="expected the columns"):
        st.read_labelled(spark, str(tmp_path / "a.csv"), "text string, label string").collect()
