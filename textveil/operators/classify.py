"""Zero-shot style classification: hypotheses, scoring and result handling.

A classified row carries its candidate labels and their logits as arrays, so
ranking and verdicts are expressions on the row and need no shuffle.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textveil.constants import (
    ALERT_SCORE,
    CONCERNING_LABELS,
    DISPLAY_LABELS,
    HYPOTHESIS_PLAIN,
    LABEL_PRESETS,
    NLI_CLASSES,
    QA_TEMPLATE,
    RELEVANCE_HYPOTHESIS,
    RELEVANCE_LABELS,
    RELEVANCE_MARKERS,
    RELEVANCE_THRESHOLD,
    SAFETY_LABELS,
)
from textveil.functions.scores import argmax, one_hot, sigmoid, softmax
from textveil.functions.text import as_col, fill_template, is_blank
from textveil.operators.ranking import with_neighbour
from textveil.operators.scrub import scrub


# --- labels -----------------------------------------------------------------

def label_set(name: str = "default_de") -> list[str]:
    return list(LABEL_PRESETS[name])


def edit_labels(labels, add: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Array of labels after adding absent, non-blank ones and removing others."""
    extra = [a.strip() for a in add if a.strip()]
    base = as_col(labels) if isinstance(labels, (str, Column)) else string_array(labels)
    return F.array_except(F.array_union(base, string_array(extra)), string_array(remove))


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def display(label, mapping: dict[str, str] | None = None) -> Column:
    """Display name of a label; labels without one stay as they are."""
    mapping = DISPLAY_LABELS if mapping is None else mapping
    if not mapping:
        return as_col(label)
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[as_col(label)], as_col(label))


# --- hypotheses and scoring -------------------------------------------------

def render_hypothesis(label, template: str = HYPOTHESIS_PLAIN) -> Column:
    """``template`` with ``{}`` replaced by the label."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), as_col(label), F.lit(after))


def hypotheses(df: DataFrame, labels: Sequence[str], template: str = HYPOTHESIS_PLAIN) -> DataFrame:
    """One row per text and candidate label, with the rendered hypothesis."""
    exploded = df.select("*", F.posexplode(string_array(labels)).alias("label_pos", "label"))
    return exploded.withColumn("hypothesis", render_hypothesis("label", template))


Scorer = Callable[[Sequence[str], Sequence[Sequence[str]]], Sequence[Sequence[float]]]


def score(
    df: DataFrame,
    load_scorer: Callable[[], Scorer],
    labels: Sequence[str],
    txt: str = "text",
    template: str = HYPOTHESIS_PLAIN,
    out: str = "logits",
) -> DataFrame:
    """Add one logit per label from a batch scorer.

    ``load_scorer`` runs once per Python task and returns a function from a
    batch of texts and their hypotheses to a batch of logits.  Only the text
    column travels to Python; blank texts never reach the scorer and get null.
    """
    rendered = [template.replace("{}", n, 1) for n in labels]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = None
        for texts in batches:
            live = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            result = [None] * len(texts)
            if live:
                scorer = scorer or load_scorer()
                scored = scorer([texts.iloc[i] for i in live], [rendered] * len(live))
                for i, row in zip(live, scored):
                    result[i] = [float(x) for x in row]
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(as_col(txt)))


def label_scores(txt, labels: Sequence[str], logits, multi_label: bool = True, mapping: dict[str, str] | None = None) -> Column:
    """``array<struct<label, display_label, score>>``, best first.

    Multi-label scores are independent, single-label scores add up to one.
    Blank texts score 0 for all labels, in the given order.
    """
    names = string_array(labels)
    scores = F.transform(as_col(logits), sigmoid) if multi_label else softmax(logits)

    def entry(label, value):
        return F.struct(
            label.alias("label"), display(label, mapping or {}).alias("display_label"), value.alias("score")
        )

    ranked = F.array_sort(
        F.zip_with(
            names,
            scores,
            lambda l, s: F.struct((-s).alias("k"), l.alias("label"), entry(l, s).alias("e")),
        )
    )
    blank = F.transform(names, lambda l: entry(l, F.lit(0.0)))
    return F.when(is_blank(txt), blank).otherwise(F.transform(ranked, lambda r: r.e))


def classify(df: DataFrame, labels: Sequence[str], txt: str = "text", logits: str = "logits", multi_label: bool = True, mapping: dict[str, str] | None = None, out: str = "result") -> DataFrame:
    """Add the ranked label scores of each text."""
    return df.withColumn(out, label_scores(txt, labels, logits, multi_label, mapping))


def top_label(result) -> Column:
    return F.coalesce(F.get(as_col(result), F.lit(0))["display_label"], F.lit(""))


def top_score(result) -> Column:
    return F.coalesce(F.get(as_col(result), F.lit(0))["score"], F.lit(0.0))


def rank_labels(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long scores ``(key, label, score)`` ranked per key: best first, then label.

    Gathers a key's few labels in a partial aggregation, so no window is needed.
    """
    gathered = scored.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "label", "score"))).alias("r")
    )
    return gathered.select(key, F.posexplode("r").alias("p", "e")).select(
        key, "e.label", "e.score", (F.col("p") + 1).alias("rank")
    )


def contrast_score(result, primary) -> Column:
    """Score of the primary hypothesis wherever it ranks, else the first score."""
    first = F.filter(as_col(result), lambda e: e.label == primary)
    return F.coalesce(F.get(first, F.lit(0))["score"], top_score(result))


def nli_probs(logits) -> Column:
    """Named probabilities of the three inference classes."""
    p = softmax(logits)
    return F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(NLI_CLASSES)])


def binary_label(logits) -> Column:
    """SAFE or UNSAFE with both probabilities; a tie is SAFE."""
    p = softmax(logits)
    return F.struct(
        F.when(argmax(logits) == 0, SAFETY_LABELS[0]).otherwise(SAFETY_LABELS[1]).alias("label"),
        F.get(p, F.lit(0)).alias("safe_prob"),
        F.get(p, F.lit(1)).alias("unsafe_prob"),
    )


def scrub_and_classify(df: DataFrame, txt: str = "text", logits: str = "logits", names=None, cities=None, **options) -> DataFrame:
    """Add the scrubbed text next to the safety label of the unscrubbed one.

    Both columns are named explicitly, since the label was not made from the
    text that is safe to pass on.  Options are those of :func:`scrub`.
    """
    verdict = binary_label(logits)
    labelled = df.select("*", verdict.alias("_v")).select("*", "_v.label", "_v.safe_prob", "_v.unsafe_prob").drop("_v")
    return scrub(labelled, txt, names, cities, out="scrubbed", **options)


def with_confidence(df: DataFrame, label_id: str = "label_id", probs: str = "probs") -> DataFrame:
    """Add probabilities (one-hot if missing), label name and confidence."""
    filled = df.withColumn(probs, F.coalesce(probs, one_hot(label_id, 2)))
    return filled.withColumn(
        "label", F.when(F.col(label_id) == 0, SAFETY_LABELS[0]).otherwise(SAFETY_LABELS[1])
    ).withColumn("confidence", F.coalesce(F.get(probs, F.col(label_id)), F.lit(1.0)))


def hypothesis_score(txt, logit) -> Column:
    """Independent score of a single hypothesis; 0 for blank texts."""
    return F.when(is_blank(txt), 0.0).otherwise(sigmoid(logit))


def content_alert(result) -> Column:
    """Entries with a concerning label and a score above the alert level."""
    return F.filter(
        as_col(result), lambda e: e.label.isin(CONCERNING_LABELS) & (e.score > ALERT_SCORE)
    )


def unsafe_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == SAFETY_LABELS[1])


# --- question and answer ----------------------------------------------------

def qa_text(question, answer) -> Column:
    return fill_template(QA_TEMPLATE, question=question, answer=answer)


def qa_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", txt: str = "text", asks: str = "user", replies: str = "assistant") -> DataFrame:
    """Each question with the reply in the directly following turn."""
    near = with_neighbour(turns, [conv], turn, {txt: "answer", role: "_next_role"})
    return near.where((F.col(role) == asks) & (F.col("_next_role") == replies)).select(
        conv, turn, F.col(txt).alias("question"), "answer"
    )


def relevance(
    df: DataFrame,
    logits: str = "logits",
    answer: str = "answer",
    labels: Sequence[str] = tuple(RELEVANCE_LABELS),
    threshold: float = RELEVANCE_THRESHOLD,
) -> DataFrame:
    """Add scores and verdict of an answer from single-label logits.

    Labels that contain a marker word count as relevance; walking the labels
    from best to worst, the last one of each kind gives its score.
    """
    ranked = F.array_sort(
        F.zip_with(
            string_array(labels),
            softmax(logits),
            lambda l, s: F.struct((-s).alias("k"), l.alias("label"), s.alias("score")),
        )
    )

    def is_marked(label):
        low = F.lower(label)
        found = low.contains(RELEVANCE_MARKERS[0])
        for m in RELEVANCE_MARKERS[1:]:
            found = found | low.contains(m)
        return found

    def last_score(entries):
        return F.coalesce(F.try_element_at(entries, F.lit(-1))["score"], F.lit(0.0))

    blank = is_blank(answer)
    ready = df.withColumn("_ranked", ranked)
    ready = ready.withColumn(
        "relevance_score",
        F.when(blank, 0.0).otherwise(last_score(F.filter("_ranked", lambda e: is_marked(e.label)))),
    ).withColumn(
        "irrelevance_score",
        F.when(blank, 1.0).otherwise(last_score(F.filter("_ranked", lambda e: ~is_marked(e.label)))),
    )
    ok = ~blank & (F.col("relevance_score") >= threshold)
    return (
        ready.withColumn("is_relevant", ok)
        .withColumn("verdict", F.when(ok, "relevant").otherwise("off-topic"))
        .drop("_ranked")
    )


def check_relevance(df: DataFrame, load_scorer: Callable[[], Scorer], question: str = "question", answer: str = "answer", **options) -> DataFrame:
    """Score ``question``/``answer`` pairs and add the verdict."""
    composed = df.withColumn("combined_input", F.when(~is_blank(answer), qa_text(question, answer)))
    scored = score(composed, load_scorer, options.get("labels", RELEVANCE_LABELS), "combined_input", RELEVANCE_HYPOTHESIS)
    return relevance(scored.withColumn("combined_input", qa_text(question, answer)), answer=answer, **options).drop("logits")


# --- result records ---------------------------------------------------------

def to_result(df: DataFrame, txt: str = "text", result: str = "result", multi_label: bool = True, out: str = "record") -> DataFrame:
    """Add the classification record as a JSON string."""
    field = lambda name: F.transform(F.col(result), lambda e: e[name])
    record = F.struct(
        F.col(txt).alias("text"),
        field("label").alias("labels"),
        field("display_label").alias("display_labels"),
        field("score").alias("scores"),
        top_label(result).alias("top_label"),
        top_score(result).alias("top_score"),
        F.lit(multi_label).alias("multi_label"),
    )
    return df.withColumn(out, F.to_json(record))
