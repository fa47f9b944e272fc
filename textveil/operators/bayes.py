"""Multinomial naive Bayes on exact token counts of whole texts, the default scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textveil.functions.text import as_col, words
from textveil.operators.ranking import kept
from textveil.operators.wordsums import WordTable, sums_by_text


def bayes_tokens(txt) -> Column:
    """Lower-cased runs of word characters."""
    return words(F.lower(F.coalesce(as_col(txt), F.lit(""))))


@dataclass(frozen=True)
class BayesModel:
    """Token counts of both classes, ``(token, c0, c1)``, and their totals."""

    counts: DataFrame
    texts: tuple[int, int]
    tokens: tuple[int, int]
    vocabulary: int


def fit_bayes(df: DataFrame, txt: str = "text", label: str = "label") -> BayesModel:
    """Count tokens per class; rows without a label are left out.

    Counts are summed in the map tasks and stored; only one row of totals reaches the driver.
    """
    known = df.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), bayes_tokens(txt).alias("w"))
    of = lambda k: F.count_if(F.col("y") == k)
    counts = known.select("y", F.explode("w").alias("token")).groupBy("token").agg(of(0).alias("c0"), of(1).alias("c1"))
    counts = kept(counts, "token-counts")
    texts = known.agg(of(0), of(1)).first()
    n0, n1, v = counts.agg(F.sum("c0"), F.sum("c1"), F.count("*")).first()
    return BayesModel(counts, (texts[0], texts[1]), (n0 or 0, n1 or 0), v)


def bayes_scores(model: BayesModel, df: DataFrame, txt: str = "text", out: str = "logits") -> DataFrame:
    """Add the array of both classes' log scores, with one added to each count.

    Tokens that training has not seen do not count.  A text's tokens are counted within
    its row, once for all rows of the same text; the model's frequent tokens come to the
    texts, only pairs with a rarer one are shuffled.
    """
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(txt, F.lit("")), 256))
    found = keyed.groupBy("_digest").agg(F.any_value(txt).alias("_text"))
    table = model.counts.select(F.col("token").alias("word"), "c0", "c1", (F.col("c0") + F.col("c1")).alias("_often"))
    gain = {f"_s{k}": F.col("tf") * F.log(F.col(f"c{k}") + 1.0) for k in (0, 1)}
    sums = sums_by_text(found, "_digest", bayes_tokens("_text"), WordTable(table, "_often"), gain | {"_n": F.col("tf")})

    def logit(k: int) -> Column:
        prior = F.log(F.lit((model.texts[k] + 1.0) / (sum(model.texts) + 2.0)))
        each = F.log(F.lit(float(model.tokens[k] + model.vocabulary + 1)))
        return prior + F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) - F.coalesce(F.col("_n"), F.lit(0)) * each

    joined = keyed.join(sums, "_digest", "left").withColumn(out, F.array(logit(0), logit(1)))
    return joined.drop("_digest", "_s0", "_s1", "_n")
