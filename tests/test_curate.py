import json
import random

import pytest
from pyspark.sql import functions as F

from textveil.operators import curate as cu
from textveil.operators import ranking as rk


def ids(df, col="doc_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_large_and_small_samples_agree(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).alias("c"))
    small = cu.balanced_sample(df, "c", 400).select("doc_id", "c").collect()
    monkeypatch.setattr(cu, "SMALL_SAMPLE", 0)
    large = cu.balanced_sample(df, "c", 400).select("doc_id", "c").collect()
    assert sorted(small) == sorted(large) and len(small) == 800
    assert cu.balanced_sample(df, "c", 10_000).count() == 5000
    for n in (1, 17, 399, 4000):
        monkeypatch.setattr(cu, "SMALL_SAMPLE", 0)
        large = sorted(cu.balanced_sample(df, "c", n).select("doc_id", "c").collect())
        monkeypatch.setattr(cu, "SMALL_SAMPLE", 10**6)
        assert large == sorted(cu.balanced_sample(df, "c", n).select("doc_id", "c").collect())
    monkeypatch.setattr(cu, "SMALL_SAMPLE", 0)
    monkeypatch.setattr(cu, "MAX_CLASSES", 0)
    assert ids(cu.balanced_sample(df, "c", 17)) == ids(cu.balanced_sample(df.repartition(3), "c", 17))
    assert cu.sample_n(df, 400).count() == 400


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert ids(cu.sample_n(df, 50)) == ids(cu.sample_n(df.repartition(13), 50))
    a = cu.split(df).where("split = 'test'")
    assert ids(a) == ids(cu.split(df.repartition(5)).where("split = 'test'"))
    assert 150 < a.count() < 250


@pytest.mark.parametrize("tasks", ["8", "64"])
def test_positions_and_totals(spark, tasks):
    rng = random.Random(3)
    values = rng.sample(range(10**6), 3000)
    df = spark.createDataFrame([(v, v % 5) for v in values], "v bigint, w bigint").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {r.v: r.position for r in rk.with_position(df, "v").collect()}
        cum = {r.v: r.cum_w for r in rk.running_totals(df, "v", ["w"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {v: i for i, v in enumerate(sorted(values))}
    total, want = 0, {}
    for v in sorted(values, reverse=True):
        total += v % 5
        want[v] = total
    assert cum == want


def test_round_robin(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(10)], "n bigint")
    rows = cu.round_robin(df, ["a", "b", "c"], "n", "x").orderBy("n").collect()
    assert [r.x for r in rows] == list("abcabcabca")


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_neighbours_and_last_seen_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for g in range(6):
        for t in sorted(rng.sample(range(40), rng.randrange(1, 15))):
            rows.append((g, t, rng.choice([None, f"v{g}-{t}"]), f"t{g}-{t}"))
    df = spark.createDataFrame(rows, "g int, t int, v string, x string").repartition(5)
    ahead = {(r.g, r.t): r.y for r in rk.with_neighbour(df, ["g"], "t", {"x": "y"}, chunk).collect()}
    behind = {(r.g, r.t): r.y for r in rk.with_neighbour(df, ["g"], "t", {"x": "y"}, chunk, ahead=False).collect()}
    seen = {(r.g, r.t): r.s for r in rk.with_last_seen(df, ["g"], "t", "v", "s", chunk).collect()}
    for i, (g, t, v, x) in enumerate(rows):
        nxt = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == g else None
        prv = rows[i - 1] if i and rows[i - 1][0] == g else None
        assert ahead[g, t] == (nxt[3] if nxt else None)
        assert behind[g, t] == (prv[3] if prv else None)
        assert seen[g, t] == next((r[2] for r in reversed(rows[: i + 1]) if r[0] == g and r[2]), None)


def test_resume_ignores_blank_sources(spark, frame):
    done = spark.createDataFrame([("a",), ("",), (None,)], "source_text string")
    assert ids(cu.pending(frame("a", "", "b", None), done)) == [2, 3, 4]


def test_new_only_first_wins(spark, frame):
    existing = spark.createDataFrame([("b",)], "text string")
    assert ids(cu.new_only(frame("a", "b", "a", "c", "b"), existing)) == [1, 4]


def test_dedupe_keeps_one_row_per_task_before_the_shuffle(frame):
    plan = cu.first_of_each(frame("a", "a"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_responses(spark):
    good = json.dumps({"examples": [{"text": "a", "label": "SAFE"}, {"text": "", "label": "X"}]})
    rows = [(1, good), (2, "not json"), (3, '{"examples": [{"te'), (4, "{}"), (5, None)]
    df = spark.createDataFrame(rows, "request_id int, response string")
    examples, rejected = cu.parse_responses(df, "examples")
    assert [tuple(r) for r in cu.valid_examples(examples, ["SAFE"]).collect()] == [(1, "a", "SAFE")]
    assert sorted(r.request_id for r in rejected.collect()) == [2, 3, 5]


def test_twins(spark):
    df = spark.createDataFrame([("böse", "gut"), ("x", None), ("y", "")], "text string, twin_text string")
    assert [tuple(r) for r in cu.twin_pairs(df).collect()] == [
        ("böse", "UNSAFE", "twin_original", ""),
        ("gut", "SAFE", "twin_generated", "böse"),
    ]


TREE = {
    "Cat": {
        "Sub": {
            "Ex": [
                {"Text": "eins"},
                {"Text": "  "},
                {"Question": "q1", "AnswerOptions": "free_text"},
                {"Question": "q2", "AnswerOptions": ["a", "b"]},
                {"Text": " zwei "},
                {"Question": "", "AnswerOptions": "free_text"},
                {"Question": "q3", "AnswerOptions": "free_text"},
            ],
            "NoText": [{"Question": "q4", "AnswerOptions": "free_text"}],
            "NotAList": {"a": 1},
        },
        "NotADict": [1, 2],
    },
    "Version": 3,
}


def test_exercises(spark, tmp_path):
    from textveil.sources.tables import read_exercises

    path = tmp_path / "tree.json"
    path.write_text(json.dumps(TREE, indent=2), encoding="utf-8")
    trees = read_exercises(spark, str(path))
    found = cu.question_contexts(cu.flatten_exercises(trees))
    assert cu.exercise_contexts(cu.exercise_lists(trees)).exceptAll(found).count() == 0
    assert sorted((r.exercise, r.text, r.question) for r in found.collect()) == [("Ex", "eins", "q1"), ("Ex", "zwei", "q3")]


def test_label_maps(spark):
    df = spark.createDataFrame([("UNSAFE",), ("SAFE",), ("other",), (None,)], "label string")
    rows = df.select(cu.to_binary("label").alias("b"), cu.map_label("label", {"SAFE": 0, "UNSAFE": 1}).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 0), (0, None), (0, None)]


def test_balance_without_unsafe(spark):
    df = spark.createDataFrame([("SAFE",)], "label string")
    assert tuple(cu.class_balance(df).first()) == (1, 0, 1, None)


def test_resolve_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "doc_id int, label int")
    assert tuple(cu.resolve_labels(df, "1").first()) == ("1", "0")
    with pytest.raises(Exception, match="label not found"):
        cu.resolve_labels(df, "UNSAFE").collect()


def test_combined_columns(spark):
    a = spark.createDataFrame([("x", "SAFE", "synthetic")], "text string, label string, source string")
    b = spark.createDataFrame([("y", "SAFE", "twin", "z")], "text string, label string, source string, source_text string")
    assert [r.source_text for r in cu.combine(a, b).collect()] == [None, "z"]


def test_grid_and_batches(spark):
    grid = cu.prompt_grid(spark).collect()
    assert len(grid) == 24 and sum(r.kind == "tricky" for r in grid) == 9
    assert [r.size for r in cu.batches(spark, 23).orderBy("batch").collect()] == [10, 10, 3]


def test_merge_takes_at_most_what_is_there(spark):
    clinical = spark.createDataFrame([("a", "UNSAFE"), ("b", "SAFE_CONTEXT")], "text string, label string")
    answers = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, answer string")
    merged = cu.merge_training_set(clinical, answers).collect()
    assert len(merged) == 2 + 27 + 2 and sum(r.label for r in merged) == 1 + 15 + 5


def test_contrastive_pairs(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    label = {r.doc_id: r.label for r in df.collect()}
    pairs = cu.contrastive_pairs(df, 4).collect()
    assert len(pairs) == 40 * 8
    for p in pairs:
        assert (label[p.left_id] == label[p.right_id]) == bool(p.same)
        assert p.left_id != p.right_id


def test_contrastive_pairs_of_small_classes(spark):
    # one class of one row, one of two, one of nine
    df = spark.range(12).select(F.col("id").alias("doc_id"), F.expr("if(id < 1, 'a', if(id < 3, 'b', 'c'))").alias("label"))
    pairs = [tuple(r) for r in cu.contrastive_pairs(df, 4).select("left_id", "right_id", "same").collect()]
    assert all(a != b for a, b, _ in pairs) and len(pairs) == len(set(pairs))
    assert sum(s for *_, s in pairs) == 0 + 2 * 1 + 9 * 4


def test_blocks_of_questions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [("a", "b", f"ex{e}", p, None if p % 2 else f" text {p} ", "wer?" if p % 2 else None, "free_text" if p % 4 == 1 else "choice") for e in range(5) for p in range(2060)]
    blocks = spark.createDataFrame(rows, "category string, subcategory string, exercise string, pos int, text string, question string, answer_options string")
    found = cu.question_contexts(blocks.withColumn("text", counted.asNondeterministic()("text"))).collect()
    assert {(r.exercise, r.pos): (r.text, r.question) for r in found} == {(f"ex{e}", p): (f"text {p - 1}", "wer?") for e in range(5) for p in range(1, 2060, 4)}
    assert len(found) == 5 * 515 and made.value == len(rows)


def test_nodes_of_trees_may_begin_with_whitespace(spark):
    tree = '{"c": {"s": {"e": [{"Text": "a"}], "f": {"Text": "b"}, "g": 3}, "t": ["x"], "u": " {}"}}'
    trees = ["", None, "[1]", "x" + tree, tree, " \t\r\n" + tree + " "]
    found = cu.exercise_lists(spark.createDataFrame([(t,) for t in trees], "tree string")).collect()
    blocks = {"e": [{"Text": "a"}], "f": None, "g": None}
    assert sorted((r.category, r.subcategory, r.exercise) for r in found) == sorted(2 * [("c", "s", e) for e in blocks])
    assert all(r.blocks == blocks[r.exercise] for r in found)
