"""Building labelled training sets: filter, sample, pair, assign, combine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textveil.constants import (
    ANSWER_LABEL,
    BATCH_SIZE,
    CLINICAL_SCENARIOS,
    FREE_TEXT,
    HARD_UNSAFE_TEXTS,
    MAX_SOURCE_CHARS,
    OUTPUT_LENGTHS,
    PROMPT_TEMPLATES,
    REPAIR_EXAMPLES,
    SEED,
    TEST_FRACTION,
    TRICKY_SCENARIOS,
)
from textveil.functions.regex import SPACE
from textveil.functions.text import fill_template, hash_key, is_blank, strip_ws
from textveil.operators.ranking import kept, with_hash_position, with_last_seen, with_offsets, with_position

# Spark keeps a window's first n rows per map task only for small n.
SMALL_SAMPLE = 1000
# Parts of a class of which each has its own first rows before the class has.
PARTS = 64
MAX_CLASSES = 10_000


# --- filters, samples, splits -----------------------------------------------

def short_texts(df: DataFrame, limit: int = MAX_SOURCE_CHARS, txt: str = "text") -> DataFrame:
    return df.where(F.length(txt) < limit)


def balanced_sample(df: DataFrame, group: str | Sequence[str], n: int, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows per class, the same ones on every run.

    Rows without a class are left out.  For small ``n`` the window's group limit
    keeps the first ``n`` rows of every task, these meet by parts of a class, and the
    first ``n`` of each part by class: no task holds more than that, whatever the
    number of tasks or the size of a class.  Otherwise counts per key range give the
    range that holds each class's cut: rows beyond it are dropped where they are
    read, and only that one range is ranked.
    """
    groups = [group] if isinstance(group, str) else list(group)
    hashed = df.dropna("any", subset=groups).withColumn("_key", hash_key(seed, key))
    if n <= SMALL_SAMPLE:
        first = hashed.withColumn("_part", F.pmod(F.crc32(F.col("_key").cast("binary")), F.lit(PARTS)))
        for keys in ([*groups, "_part"], groups):
            order = Window.partitionBy(*keys).orderBy("_key")
            first = first.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
        return first.drop("_rn", "_key", "_part")
    ranged = hashed.withColumn("_range", F.substring("_key", 1, 4))
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    needed = counts.withColumn("_before", before).where(F.col("_before") < n)
    cuts = needed.groupBy(*groups).agg(F.max("_range").alias("_cut"), F.max("_before").alias("_before"))
    cuts = small_or_joined(cuts)
    near = ranged.join(cuts, groups).where(F.col("_range") <= F.col("_cut"))
    inside = Window.partitionBy(*groups, "_range").orderBy("_key")
    ranked = near.withColumn("_rn", F.row_number().over(inside))
    kept = (F.col("_range") < F.col("_cut")) | (F.col("_before") + F.col("_rn") <= n)
    return ranked.where(kept).drop("_rn", "_key", "_range", "_cut", "_before")


def small_or_joined(df: DataFrame, limit: int = MAX_CLASSES) -> DataFrame:
    """``df`` as a broadcast if it has at most ``limit`` rows, else as it is."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def sample_n(df: DataFrame, n: int, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``min(n, rows)`` rows of the whole table, the same ones on every run."""
    return balanced_sample(df.withColumn("_all", F.lit(1)), "_all", n, seed, key).drop("_all")


def cap(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def shuffle(df: DataFrame, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """All rows in seeded random order, by a range-partitioned sort.

    Rows of one key may be many, so they may come to lie in several ranges.
    """
    return df.orderBy(hash_key(seed, key), key, F.monotonically_increasing_id())


def split(df: DataFrame, fraction: float = TEST_FRACTION, seed: int = SEED, key: str = "doc_id", out: str = "split") -> DataFrame:
    """Mark each row ``train`` or ``test``; a row's side never changes."""
    bound = format(min(int(fraction * 2**32), 2**32 - 1), "08x")
    head = F.substring(hash_key(seed, key), 1, 8)
    return df.withColumn(out, F.when(head < bound, "test").otherwise("train"))


# --- combining and deduplication --------------------------------------------

def combine(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pending(df: DataFrame, done: DataFrame, txt: str = "text", done_txt: str = "source_text") -> DataFrame:
    """Rows whose text is not yet among the source texts already processed."""
    keys = done.where(F.col(done_txt).isNotNull() & (F.col(done_txt) != "")).select(digest(done_txt).alias("_done"))
    return df.join(keys.distinct(), digest(txt) == F.col("_done"), "left_anti")


def digest(txt) -> Column:
    """A SHA-256 key, so that only keys of the other side are shuffled."""
    return F.sha2(F.col(txt), 256)


def first_of_each(df: DataFrame, txt: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of every distinct text.

    ``row_number() = 1`` keeps one row per text in each map task before the
    shuffle, so a text with very many copies stays small.  Texts meet and are
    sorted by their digests.
    """
    w = Window.partitionBy(digest(txt)).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def new_only(df: DataFrame, existing: DataFrame | None = None, txt: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows with a text neither among ``existing`` nor earlier in the batch."""
    fresh = first_of_each(df, txt, order)
    if existing is None:
        return fresh
    seen = existing.select(digest(txt).alias("_seen")).distinct()
    return fresh.join(seen, digest(txt) == F.col("_seen"), "left_anti")


# --- labels and provenance --------------------------------------------------

def map_class(cls) -> Column:
    c = F.col(cls) if isinstance(cls, str) else cls
    return F.when(c == "suicide", "UNSAFE").otherwise("SAFE")


def tag(df: DataFrame, label: str | Column, source: str, source_text: str | Column | None = None) -> DataFrame:
    """Add label and provenance columns; ``source_text`` only where given."""
    out = df.withColumn("label", F.lit(label)).withColumn("source", F.lit(source))
    return out if source_text is None else out.withColumn("source_text", F.lit(source_text))


def to_binary(label) -> Column:
    """1 for exactly UNSAFE, otherwise 0, also for missing labels."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == "UNSAFE", 1).otherwise(0)


def map_label(label, mapping: dict[str, int]) -> Column:
    """The mapped label, null when it is unknown."""
    c = F.col(label) if isinstance(label, str) else label
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def valid_examples(df: DataFrame, labels: Sequence[str], txt: str = "text", label: str = "label") -> DataFrame:
    return df.where((F.col(txt) != "") & F.col(label).isin(list(labels)))


def class_balance(df: DataFrame, label: str = "label", safe="SAFE", unsafe="UNSAFE") -> DataFrame:
    """One row: counts of both classes, total, and safe per unsafe."""
    c = F.col(label)
    one = df.agg(
        F.count_if(c == safe).alias("safe_count"),
        F.count_if(c == unsafe).alias("unsafe_count"),
        F.count("*").alias("total"),
    )
    ratio = F.try_divide(F.col("safe_count").cast("double"), F.col("unsafe_count"))
    return one.withColumn("ratio", ratio)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, missing values left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, col: str = "category") -> DataFrame | None:
    return value_counts(df, col) if col in df.columns else None


def resolve_labels(df: DataFrame, positive, label: str = "label", order: str = "doc_id") -> DataFrame:
    """``(positive, negative)``: the label equal to ``positive`` as a string,
    and the first other label by ``order``; an error where one is missing."""
    first = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("l")).agg(F.min(order).alias("o"))
    same = F.col("l") == F.lit(str(positive))
    one = first.agg(
        F.max(F.when(same, F.col("l"))).alias("positive"),
        F.min_by(F.col("l"), F.when(~same, F.col("o"))).alias("negative"),
    )
    return one.select(
        F.when(F.col("positive").isNull(), F.raise_error(F.lit(f"label not found: {positive}")).cast("string"))
        .otherwise(F.col("positive"))
        .alias("positive"),
        F.when(F.col("negative").isNull(), F.raise_error(F.lit("no second label")).cast("string"))
        .otherwise(F.col("negative"))
        .alias("negative"),
    )


# --- requests ---------------------------------------------------------------

def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def round_robin(df: DataFrame, values: Sequence[str], order: str, out: str) -> DataFrame:
    """The i-th row by ``order`` gets value ``i % len(values)``."""
    placed = with_position(df, order, "_position")
    at = F.pmod(F.col("_position"), F.lit(len(values))).cast("int")
    return placed.withColumn(out, F.get(literal_array(values), at)).drop("_position")


def prompt_grid(spark: SparkSession, clinical: Sequence[str] = tuple(CLINICAL_SCENARIOS), tricky: Sequence[str] = tuple(TRICKY_SCENARIOS), lengths: Sequence[str] = tuple(OUTPUT_LENGTHS)) -> DataFrame:
    """One request per scenario and length: ``(request_id, kind, scenario, length)``."""
    cells = [("clinical", s, n) for s in clinical for n in lengths]
    cells += [("tricky", s, n) for s in tricky for n in lengths]
    rows = [(i, *c) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "request_id int, kind string, scenario string, length string")


def render_prompts(df: DataFrame, template: str, out: str = "prompt", **fields) -> DataFrame:
    """Fill a request template (by name or as text) from the row."""
    return df.withColumn(out, fill_template(PROMPT_TEMPLATES.get(template, template), **fields))


def batches(spark: SparkSession, n: int, size: int = BATCH_SIZE) -> DataFrame:
    """Batch numbers and sizes that make up ``n`` rows."""
    return (
        spark.range((n + size - 1) // size)
        .select(F.col("id").cast("int").alias("batch"))
        .withColumn("size", F.least(F.lit(size), F.lit(n) - F.col("batch") * size).cast("bigint"))
    )


# --- responses --------------------------------------------------------------

_RESPONSE_DDL = {
    "examples": "examples array<struct<text:string,label:string>>",
    "sentences": "sentences array<string>",
    "twin_text": "twin_text string",
}


def read_response(response, kind: str) -> Column:
    """The parsed response, null when it is malformed."""
    c = F.col(response) if isinstance(response, str) else response
    whole = strip_ws(c).startswith("{")
    return F.when(whole, F.from_json(c, _RESPONSE_DDL[kind], {"mode": "PERMISSIVE"}))


def parse_responses(df: DataFrame, kind: str, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """Rows of all readable responses, and the rejected input rows."""
    parsed = df.withColumn("_parsed", read_response(response, kind))
    payload = F.col("_parsed")[kind]
    corrupt = F.col("_parsed").isNull() | (payload.isNull() & F.get_json_object(response, "$").isNull())
    rejected = parsed.where(corrupt).drop("_parsed")
    # an unreadable response has no rows, so the good side needs no filter
    good = parsed
    keep = [c for c in df.columns if c != response]
    if kind == "examples":
        rows = good.select(*keep, F.inline(payload))
    elif kind == "sentences":
        rows = good.select(*keep, F.explode(payload).alias("text"))
    else:
        rows = good.select(*keep, payload.alias("twin_text")).where("twin_text <> ''")
    return rows, rejected


def twin_pairs(df: DataFrame, txt: str = "text", twin: str = "twin_text") -> DataFrame:
    """Two rows per example with a twin: the UNSAFE original, the SAFE twin."""
    keep = [c for c in df.columns if c not in (txt, twin, "label", "source", "source_text")]

    def row(text, label, source, source_text):
        return F.struct(
            text.alias("text"), F.lit(label).alias("label"), F.lit(source).alias("source"), source_text.alias("source_text")
        )

    pair = F.array(
        row(F.col(txt), "UNSAFE", "twin_original", F.lit("")),
        row(F.col(twin), "SAFE", "twin_generated", F.col(txt)),
    )
    return df.where(F.col(twin).isNotNull() & (F.col(twin) != "")).select(*keep, F.inline(pair))


# --- exercises and answers --------------------------------------------------

_NODES = "map<string,string>"


def _object_nodes(raw) -> Column:
    return F.when(raw.rlike(f"^{SPACE}*\\{{"), F.from_json(raw, _NODES))


def exercise_lists(df: DataFrame, tree: str = "tree") -> DataFrame:
    """Exercises of category -> subcategory -> exercise -> [block] trees.

    Trees are JSON text.  Nodes of another shape are skipped level by level;
    each exercise keeps its array of blocks.
    """
    keep = [c for c in df.columns if c != tree]
    cats = df.select(*keep, F.explode(_object_nodes(F.col(tree))).alias("category", "_sub"))
    subs = cats.select(*keep, "category", F.explode(_object_nodes(F.col("_sub"))).alias("subcategory", "_ex"))
    exs = subs.select(*keep, "category", "subcategory", F.explode(_object_nodes(F.col("_ex"))).alias("exercise", "_blocks"))
    listed = F.when(F.col("_blocks").rlike(f"^{SPACE}*\\["), F.from_json("_blocks", f"array<{_NODES}>"))
    return exs.select(*keep, "category", "subcategory", "exercise", listed.alias("blocks"))


def flatten_exercises(df: DataFrame, tree: str = "tree") -> DataFrame:
    """One row per block of all exercises in the trees."""
    keep = [c for c in df.columns if c != tree]
    found = exercise_lists(df, tree)
    path = [*keep, "category", "subcategory", "exercise"]
    blocks = found.select(*path, F.posexplode_outer("blocks").alias("pos", "_b")).where("pos is not null")
    return blocks.select(
        *keep,
        "category",
        "subcategory",
        "exercise",
        "pos",
        F.col("_b")["Text"].alias("text"),
        F.col("_b")["Question"].alias("question"),
        F.col("_b")["AnswerOptions"].alias("answer_options"),
    )


def exercise_contexts(exercises: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Free-text questions with the last non-blank text block before them.

    Works inside each exercise's own array, so nothing is shuffled.
    """
    keep = [c for c in exercises.columns if c != blocks]
    start = F.struct(
        F.lit(None).cast("string").alias("last"),
        F.array().cast("array<struct<pos:int,text:string,question:string>>").alias("found"),
    )
    numbered = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def step(acc, n):
        is_text = F.map_contains_key(n.b, "Text")
        said = F.when(~is_blank(n.b["Text"]), strip_ws(n.b["Text"]))
        asked = (
            ~is_text & (n.b["AnswerOptions"] == FREE_TEXT) & (n.b["Question"] != "") & acc.last.isNotNull()
        )
        row = F.struct(n.i.alias("pos"), acc.last.alias("text"), n.b["Question"].alias("question"))
        return F.struct(
            F.when(is_text, F.coalesce(said, acc.last)).otherwise(acc.last).alias("last"),
            F.when(asked, F.concat(acc.found, F.array(row))).otherwise(acc.found).alias("found"),
        )

    found = F.aggregate(numbered, start, step, lambda acc: acc.found)
    return exercises.select(*keep, F.inline(found))


def question_contexts(blocks: DataFrame, path: Sequence[str] = ("category", "subcategory", "exercise"), pos: str = "pos") -> DataFrame:
    """Like :func:`exercise_contexts` for tables with one row per block.

    What matters of the blocks is written once: they are read three times, and may come
    from trees that are costly to parse.
    """
    asked = F.col("text").isNull() & (F.col("question") != "") & (F.col("answer_options") == FREE_TEXT)
    said = F.when(~is_blank("text"), strip_ws("text"))
    usable = blocks.select(*path, pos, said.alias("_text"), F.when(asked, F.col("question")).alias("question"))
    usable = kept(usable.where("_text is not null or question is not null"), "blocks")
    filled = with_last_seen(usable, list(path), pos, "_text", "_context")
    found = filled.where(F.col("question").isNotNull() & F.col("_context").isNotNull())
    return found.select(*path, pos, F.col("_context").alias("text"), "question")


def answer_rows(df: DataFrame) -> DataFrame:
    return df.select("exercise", "text", "question", strip_ws("answer").alias("answer"), "length_instruction")


def answers_as_examples(df: DataFrame, label: str = ANSWER_LABEL) -> DataFrame:
    """Answers as training texts."""
    return df.select(F.col("answer").alias("text"), F.lit(label).alias("label"))


def literal_examples(spark: SparkSession) -> DataFrame:
    """The hand-written rows: hard cases and repairs."""
    rows = [(t, "UNSAFE") for t in HARD_UNSAFE_TEXTS] + list(REPAIR_EXAMPLES)
    return spark.createDataFrame(rows, "text string, label string")


def merge_training_set(clinical: DataFrame, answers: DataFrame, n_answers: int = 75, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Clinical rows, hand-written rows and sampled answers, binary, shuffled."""
    picked = answers_as_examples(sample_n(answers, n_answers, seed, key))
    rows = combine(clinical.select("text", "label"), literal_examples(clinical.sparkSession), picked)
    return shuffle(rows.withColumn("label", to_binary("label")), seed, "text")


# --- pairs for contrastive training -----------------------------------------

def class_offsets(sizes: DataFrame) -> DataFrame:
    """``(c, n)`` with ``before``: the rows of all classes earlier in the order of a hash of ``c``.

    Classes may be many: they are summed by ranges of the hash.
    """
    ranged = sizes.withColumn("_k", F.md5(F.col("c").cast("string"))).withColumn("_range", F.substring("_k", 1, 3))
    inside = Window.partitionBy("_range").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_offsets(ranged, [], {"n": F.sum("n")})
    before = F.col("_before_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return placed.withColumn("before", before.cast("bigint")).select("c", "n", "before")


def contrastive_pairs(df: DataFrame, n: int = 10, label: str = "label", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Up to ``n`` partners of the same class and up to ``n`` of all other classes per row.

    Rows get a seeded position in their class, and classes follow each other, so every
    row has a place in the whole.  The r-th partner of the same class is the row r
    places further on, wrapping around.  The r-th of the others is found among the
    places outside the own class, in steps that go once around all of them: as the own
    class is left out by adding its size, one equi-join on the place finds every pair.
    No row is its own partner and no partner repeats, so a class of m rows gives
    m - 1 partners at most and a class of one row none of its own.
    Yields ``(left_id, right_id, iteration, same)``.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("c"))
    placed = with_hash_position(rows.withColumn("_k", hash_key(seed, "id")), "_k", ["c"], "p").select("id", "c", "p")
    offsets = class_offsets(rows.groupBy("c").agg(F.count("*").alias("n")))
    total = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    placed = placed.join(offsets, "c").withColumn("m", total - F.col("n")).withColumn("at", F.col("before") + F.col("p"))
    wanted = placed.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n))))
    step = F.greatest(F.floor(F.col("m") / n), F.lit(1))
    outside = F.when(F.col("m") > 0, F.pmod(F.col("p") + (F.col("r") - 1) * step, F.col("m")))
    targets = F.array(
        F.struct(F.lit(1).alias("same"), (F.col("before") + F.pmod(F.col("p") + F.col("r"), F.col("n"))).alias("at"), (F.col("r") < F.col("n")).alias("real")),
        F.struct(F.lit(0).alias("same"), F.when(outside < F.col("before"), outside).otherwise(outside + F.col("n")).alias("at"), (F.col("r") <= F.col("m")).alias("real")),
    )
    asked = wanted.select(F.col("id").alias("left_id"), F.col("r").alias("iteration"), F.inline(targets)).where("real")
    partners = placed.select(F.col("id").alias("right_id"), "at")
    return asked.join(partners, "at").select("left_id", "right_id", "iteration", "same")
