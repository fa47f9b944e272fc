"""Scores of texts for any list of labels or hypotheses, by their word profiles.

A label's prototype is the sum of the weighted words of what stands for it: the
hypothesis itself, a description, or example texts.  A text's score is the cosine of
its own weighted words and the prototype.  Words weigh by how rare they are in a
corpus, so what every text says counts little.

Texts and prototypes meet through an inverted index, an equi-join on words: the
frequent ones are a broadcast, pairs of a text and a rarer word are shuffled (see
``wordsums``), so the work does not grow with texts times labels, and both sides may
have any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textveil.constants import HYPOTHESIS_PLAIN
from textveil.functions.text import as_col, is_blank
from textveil.operators.bayes import bayes_tokens
from textveil.operators.classify import render_hypothesis
from textveil.operators.ranking import kept, with_position
from textveil.operators.wordsums import WordTable, sums_by_text, word_pairs

SCALE = 10.0  # logit of a cosine of 1


def said(tf: Column) -> Column:
    """The part of a word's weight that its count in the text makes."""
    return 1.0 + F.log(tf.cast("double"))


@dataclass(frozen=True)
class Vocabulary:
    """In how many of ``texts`` distinct texts each word occurs: ``(word, df)``."""

    words: DataFrame
    texts: int

    def weight(self, tf: Column) -> Column:
        """Weight of a word by its count and its ``df`` (null: in no text)."""
        return said(tf) * self.rarity()

    def rarity(self) -> Column:
        return F.log((1.0 + self.texts) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0


def fit_vocabulary(corpus: DataFrame, txt: str = "text") -> Vocabulary:
    """Document frequencies over the distinct texts that are not blank."""
    texts = corpus.where(~is_blank(txt)).select(F.sha2(txt, 256).alias("_d"), F.col(txt).alias("_t"))
    one = texts.groupBy("_d").agg(F.any_value("_t").alias("_t"))
    rows = one.select(F.explode(F.array_distinct(bayes_tokens("_t"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return Vocabulary(kept(rows, "vocabulary"), one.count())


def term_dictionary(vocabulary: Vocabulary) -> DataFrame:
    """``(word, id, df)``: words numbered from 0 by falling document frequency, then by themselves.

    The numbers come from sorted ranges and their offsets, so the dictionary may have
    any size, and frequent words have small numbers.
    """
    return with_position(vocabulary.words, [F.desc("df"), F.asc("word")], "id").select("word", "id", "df")


def tfidf(df: DataFrame, vocabulary: Vocabulary, dictionary: DataFrame, key: str = "doc_id", txt: str = "text") -> DataFrame:
    """``(key, id, tf, weight)`` of each row's words; unknown words are left out.

    Weights of a row have length 1 together.  Rows of one key count as one text.
    """
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(txt).alias("_texts"))
    tokens = F.flatten(F.transform("_texts", bayes_tokens))
    table, w = WordTable(kept(dictionary, "dictionary"), "df"), vocabulary.weight(F.col("tf"))
    length = sums_by_text(rows, key, tokens, table, {"_sq": w * w}).select(key, F.sqrt("_sq").alias("_len"))
    parts = table.parts(word_pairs(rows.join(length.hint("shuffle_hash"), key), [key, "_len"], tokens))
    return reduce(DataFrame.unionByName, parts).select(key, "id", "tf", (w / F.col("_len")).alias("weight"))


def text_lengths(texts: DataFrame, vocabulary: Vocabulary, key: str, txt: str) -> DataFrame:
    """``(key, _len)``: the length of each text's weights, taken as a vector."""
    w = vocabulary.weight(F.col("tf"))
    squares = sums_by_text(texts, key, bayes_tokens(txt), WordTable(vocabulary.words, "df"), {"_sq": w * w}, unknown=True)
    return squares.select(key, F.sqrt("_sq").alias("_len"))


def fit_prototypes(examples: DataFrame, vocabulary: Vocabulary, label: str = "label", txt: str = "text") -> DataFrame:
    """``(label, word, p)`` of length 1 per label, from texts that stand for labels.

    Each text counts with its own length as 1, so a long example says no more than
    a short one.  Labels without any word have no row and score 0 everywhere.
    """
    known = examples.where(F.col(label).isNotNull() & ~is_blank(txt)).select(F.col(label).alias("label"), F.col(txt).alias("_t"))
    keyed = known.withColumn("_d", F.sha2(F.concat_ws("\0", F.col("label").cast("string"), "_t"), 256))
    texts = keyed.groupBy("_d").agg(F.any_value("label").alias("label"), F.any_value("_t").alias("_t"), F.count("*").alias("_times"))
    size = text_lengths(texts, vocabulary, "_d", "_t").hint("shuffle_hash")
    shares = texts.join(size, "_d").withColumn("_share", F.col("_times") / F.col("_len"))
    # a word's rarity is the same in all texts, so it comes in after they are added up
    parts = word_pairs(shares, ["label", "_share"], bayes_tokens("_t")).groupBy("label", "word").agg(F.sum(said(F.col("tf")) * F.col("_share")).alias("_s"))
    summed = kept(parts.join(vocabulary.words, "word", "left").select("label", "word", (F.col("_s") * vocabulary.rarity()).alias("p")), "prototypes")
    length = summed.groupBy("label").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("_len"))
    return summed.join(length, "label").select("label", "word", (F.col("p") / F.col("_len")).alias("p"))


def label_prototypes(labels: Sequence[str], vocabulary: Vocabulary, template: str = HYPOTHESIS_PLAIN) -> DataFrame:
    """Prototypes of labels that only their hypothesis stands for."""
    spark = vocabulary.words.sparkSession
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    return fit_prototypes(rows.withColumn("text", render_hypothesis("label", template)), vocabulary)


def _by_digest(df: DataFrame, txt: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a digest of their text, and each text that is not blank once."""
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(as_col(txt), F.lit("")), 256))
    texts = keyed.where(~is_blank(txt)).groupBy("_digest").agg(F.any_value(txt).alias("_text"))
    return keyed, texts


def prototype_logits(df: DataFrame, labels: Sequence, prototypes: DataFrame, vocabulary: Vocabulary, txt: str = "text", scale: float = SCALE, out: str = "logits") -> DataFrame:
    """Add one logit per label of a list, in its order: ``scale`` times the cosine, 0 for no common word.

    What :func:`textveil.operators.classify.classify` takes.  Rows meet their scores by
    a digest of the text: equal texts are scored once, null and blank ones get zeros.
    """
    keyed, texts = _by_digest(df, txt)
    kind = dict(prototypes.dtypes)["label"]
    of = [F.sum(F.when(F.col("label") == F.lit(x).cast(kind), F.col("p"))) for x in labels]
    profiles = prototypes.groupBy("word").agg(F.array(*of).alias("_p"))
    table = kept(vocabulary.words.join(profiles, "word", "full"), "profiles")
    w = vocabulary.weight(F.col("tf"))
    sums = {f"_s{i}": w * F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(len(labels))}
    found = sums_by_text(texts, "_digest", bayes_tokens("_text"), WordTable(table, "df"), {"_sq": w * w} | sums, unknown=True)
    scores = found.select("_digest", F.array(*[F.col(x) / F.sqrt("_sq") * scale for x in sums]).alias("_scores"))
    joined = keyed.join(scores, "_digest", "left")
    each = F.coalesce("_scores", F.array(*[F.lit(0.0)] * len(labels)).cast("array<double>"))
    return joined.withColumn(out, each).drop("_digest", "_scores")


def best_hypotheses(df: DataFrame, prototypes: DataFrame, vocabulary: Vocabulary, txt: str = "text", k: int = 1) -> DataFrame:
    """The input rows with ``label``, ``cosine`` and ``rank`` of their ``k`` best of any number of hypotheses.

    Rows that share no word with any hypothesis are left out; ties go to the smaller label.
    """
    keyed, texts = _by_digest(df, txt)
    w = vocabulary.weight(F.col("tf"))
    table = kept(prototypes.join(vocabulary.words, "word", "left"), "profiles")
    dots = sums_by_text(texts, "_digest", bayes_tokens("_text"), WordTable(table, "df"), {"_dot": w * F.col("p")}, by=("label",))
    length = text_lengths(texts, vocabulary, "_digest", "_text")
    found = dots.join(length.hint("shuffle_hash"), "_digest").withColumn("cosine", F.col("_dot") / F.col("_len"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("k"), "label", "cosine")))
    top = found.groupBy("_digest").agg(F.slice(order, 1, k).alias("_best"))
    rows = keyed.join(top, "_digest").select(*df.columns, F.posexplode("_best").alias("_p", "_b"))
    return rows.select(*df.columns, "_b.label", "_b.cosine", (F.col("_p") + 1).alias("rank"))
