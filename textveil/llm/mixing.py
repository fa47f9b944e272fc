"""Mix sources to target weights by weighted sampling without replacement.

Every source gets a target in words.  Whole epochs of a source come first; what
is left of its target goes to its documents in the order of exponential keys
scaled by quality weights (Efraimidis and Spirakis: key = -ln(u) / weight, small
keys first), each taking its words until the budget is used up.  The document at
the edge is taken in part, so a source meets its target to the word.

The order needs no task that sees a whole source: keys are cut into ranges whose
word sums tell where in each source the budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.llm.frames import stored, unit_hash, word_count

#: Signs that hardly occur in good prose; a fixed list.
JUNK = "!#$%&*+<=>@[]^_{|}~0123456789"


def quality_weight(text: str = "text") -> Column:
    """Between 0.05 and 1: less for texts with many junk signs."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 5 * junk / F.greatest(n, F.lit(1))), F.lit(1.0))


def _ranked_sources(sized: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with sums and weights, the latter by the place in code point order."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.orderBy(F.asc_nulls_last("source")).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    placed = stored(ordered, "sources")
    # one row per partition of the sort
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return placed.join(F.broadcast(parts), "_part").select("source", "source_size", weight.alias("weight"))


def _targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets by weight, none above ``most`` times its source's size.

    A target is the smaller of that limit and weight times a level.  The level
    rises as limited sources hand on their excess; each round is one sum over the
    sources, and only three numbers reach the driver.
    """
    limit = most * F.col("source_size")
    level, stopped = 0.0, -1
    while True:
        full = limit < level * F.col("weight")
        n, used, open_, total = sources.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum("source_size"), F.lit(0)),
        ).first()
        if n == stopped or not open_:
            break
        stopped, level = n, (share * total - used) / open_
    return sources.withColumn("target", F.least(limit, F.col("weight") * level).cast("double"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    weight: Column | None = None,
) -> DataFrame:
    """How many words the mix takes from each document.

    ``weights`` repeat over the sources in code point order, null last; together
    the targets are ``share`` times all words, each at most ``most`` times its
    source.  Columns: doc_id, source, row_hash, size, source_size, target, taken.

    Null texts and texts without words have size 0 and take 0.  Null ids and
    repeated rows are rows like others; equal rows share a key and may only differ
    in which of them lies at the edge.  The same rows give the same mix.  An empty
    table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    weight = quality_weight() if weight is None else weight
    row_hash = F.xxhash64(F.lit(seed), "doc_id", "text")
    base = docs.select(
        "doc_id", "source", row_hash.alias("row_hash"), word_count("text").alias("size"), weight.alias("_weight")
    )
    sized = stored(
        base.withColumn("_key", -F.log(unit_hash("row_hash")) / F.greatest("_weight", F.lit(1e-9))), "sized"
    )
    n_rows, mean = sized.agg(F.count("*"), F.coalesce(F.avg("_weight"), F.lit(1.0))).first()
    # ranges of keys grow with the table, as does the number of rows in each
    ranges = max(64, int(n_rows**0.5))
    bucket = F.least(F.floor((1 - F.exp(-F.col("_key") * mean)) * ranges), F.lit(ranges - 1))
    sized = sized.withColumn("_bucket", bucket.cast("int"))
    targets = _targets(stored(_ranked_sources(sized, weights), "weights"), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.select("source", "source_size", "target", epochs.cast("bigint").alias("_epochs"))
    plan = plan.withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")))
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    below = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_below", F.coalesce(F.sum("_words").over(below), F.lit(0)))
    s, p = sums.alias("s"), plan.alias("p")
    cuts = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.source").alias("_source"), F.col("_bucket").alias("_b"), "_below", "source_size", "target", "_epochs", "_rest"
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "row_hash", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.withColumn("_run", F.sum("size").over(inside) - F.col("size"))
    both = run.join(cuts, run["source"].eqNullSafe(cuts["_source"]) & (run["_bucket"] == cuts["_b"]))
    left = F.col("_rest") - F.col("_below") - F.col("_run")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    taken = (F.col("_epochs") * F.col("size") + part).cast("bigint")
    return both.select("doc_id", "source", "row_hash", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: one row per epoch, the part at the edge cut off.

    A document taken k times whole is there k times; a part keeps its first words
    with the space before each, and ``n_chars`` follows where there is such a
    column.  Rows of equal id and text are there as often as the mix takes them all
    together, each time with the other columns of one of them.
    """
    seed = how.get("seed", 17)
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    times = F.array_repeat(F.col("size").cast("int"), full)
    times = F.when(part > 0, F.array_append(times, part)).otherwise(times)
    # one small row for each row of the result
    copies = mix_sources(docs, **how).where("taken > 0")
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_rh"), F.col("size").alias("_size"), F.explode(times).alias("_words"))
    one = docs.withColumn("_row", F.xxhash64(F.lit(seed), "doc_id", "text")).dropDuplicates(["_row", "doc_id"])
    each = one.join(copies, (F.col("_row") == F.col("_rh")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, F.col("_words"))
    text = F.when(F.col("_words") < F.col("_size"), F.array_join(words, "")).otherwise(F.col("text"))
    out = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col("_words") < F.col("_size"), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
