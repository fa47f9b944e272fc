"""Queries: text classifiers, contrastive pairs and vector classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import Window, functions as F

from textveil.constants import FUNCTIONAL_EXAMPLES
from textveil.functions.scores import argmax
from textveil.functions.text import hash_key
from textveil.operators import bayes as by
from textveil.operators import curate as cu
from textveil.operators import descent as gd
from textveil.operators import evaluate as ev
from textveil.operators import prototypes as pr
from textveil.operators import train as tr
from textveil.operators.ranking import with_hash_position
from textveil.plans.registry import query, spread, table
from textveil.sources.workspace import new_dir


def labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(labels, "doc_id")


@query(
    "t1_text_features",
    r"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))::INTEGER AS n_tokens FROM documents""",
)
def t1(spark, sf):
    docs = tr.readable(table(spark, sf, "documents").select("doc_id", "text"))
    done = Pipeline(stages=tr.text_features()[:2]).fit(docs).transform(docs)
    return done.select("doc_id", F.size("_tokens").alias("n_tokens"))


_TERMS = r"""tx AS (SELECT DISTINCT text FROM documents WHERE regexp_matches(text, '[^\s]')),
terms AS (SELECT *, row_number() OVER (ORDER BY df DESC, word) - 1 AS id FROM (
  SELECT w AS word, count(*) AS df FROM (SELECT DISTINCT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM tx) GROUP BY 1))"""


@query("t1_term_dictionary", f"WITH {_TERMS} SELECT word, id, df FROM terms")
def t1_terms(spark, sf):
    """All words of the documents, numbered by how many texts have them."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return pr.term_dictionary(pr.fit_vocabulary(docs))


@query(
    "t1_tfidf",
    rf"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM tx),
    c AS (SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents) GROUP BY 1, 2),
    x AS (SELECT doc_id, id, tf, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM c JOIN terms USING (word), n)
    SELECT doc_id, id, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
)
def t1_weights(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    vocabulary = pr.fit_vocabulary(docs)
    weights = pr.tfidf(docs, vocabulary, pr.term_dictionary(vocabulary))
    return weights.withColumn("weight", F.round("weight", 6))


@query("t2_safety_predictions")
def t2(spark, sf):
    data = labelled(spark, sf)
    model = tr.fit_safety(data)
    scored = tr.predict(model, spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    return scored.select("doc_id", "y_pred", F.round(F.element_at("probs", 2), 4).alias("unsafe_prob"))


@query("t2_prediction_rules", "SELECT doc_id, 1.0::DOUBLE AS total, true AS is_argmax FROM documents")
def t2_rules(spark, sf):
    """What holds for each document whatever was learnt."""
    scored = tr.predict(tr.fit_safety(labelled(spark, sf)), spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    total = F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 9)
    return scored.select("doc_id", total.alias("total"), (F.get("probs", "y_pred") == F.array_max("probs")).alias("is_argmax"))


_BAYES = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS token FROM documents),
cnt AS (SELECT token, count(*) FILTER (toxic = 0) AS c0, count(*) FILTER (toxic = 1) AS c1 FROM tok JOIN labels USING (doc_id) GROUP BY 1),
tot AS (SELECT sum(c0) + count(*) + 1 AS n0, sum(c1) + count(*) + 1 AS n1 FROM cnt),
pri AS (SELECT count(*) FILTER (toxic = 0) + 1.0 AS t0, count(*) FILTER (toxic = 1) + 1.0 AS t1 FROM labels JOIN documents USING (doc_id)),
per AS (SELECT doc_id, sum(ln(c1 + 1.0::DOUBLE) - ln(c0 + 1.0::DOUBLE)) AS g, count(*) AS n FROM tok JOIN cnt USING (token) GROUP BY 1),
bayes AS (
  SELECT d.doc_id, ln((t1 / t0)::DOUBLE) + coalesce(g, 0) - coalesce(n, 0) * (ln(n1::DOUBLE) - ln(n0::DOUBLE)) AS margin
  FROM documents d LEFT JOIN per USING (doc_id), tot, pri)"""


def bayes_scored(spark, sf):
    """All documents with the default scorer's logits, its label and its margin."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    scored = by.bayes_scores(by.fit_bayes(labelled(spark, sf)), docs)
    margin = F.get("logits", F.lit(1)) - F.get("logits", F.lit(0))
    return scored.select("doc_id", margin.alias("margin"), argmax("logits").cast("int").alias("y_pred"))


@query("c3_default_scorer", f"WITH {_BAYES} SELECT doc_id, round(margin, 3) AS margin, (margin > 0)::INTEGER AS y_pred FROM bayes")
def c3_default(spark, sf):
    return bayes_scored(spark, sf).withColumn("margin", F.round("margin", 3))


@query(
    "e14_scored_documents",
    f"""WITH {_BAYES}, p AS (SELECT toxic AS t, (margin > 0)::INTEGER AS y FROM bayes JOIN labels USING (doc_id)),
    cell AS (SELECT unnest([0, 0, 1, 1]) AS y_true, unnest([0, 1, 0, 1]) AS y_pred)
    SELECT y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, (SELECT count(*) FROM p WHERE t = y_true AND y = y_pred) AS n FROM cell""",
)
def e14_scored(spark, sf):
    """From text to metric: the default scorer held against the labels."""
    truth = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y_true"))
    found = bayes_scored(spark, sf).join(truth, "doc_id")
    counts = found.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    cells = spark.createDataFrame([(t, p) for t in (0, 1) for p in (0, 1)], "y_true int, y_pred int")
    return cells.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


@query("t3_model_selection")
def t3(spark, sf):
    _, candidates = tr.select_best(labelled(spark, sf))
    return candidates


_SIDES = """sides AS (
  SELECT doc_id, toxic, substr(md5('42:' || doc_id), 1, 8) < '33333333' AS test FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"""


@query(
    "t3_patience",
    f"""WITH {_SIDES} SELECT count(*) FILTER (test) AS held_out, count(*) FILTER (test AND toxic = 1) AS positives,
    true AS in_order, true AS best_is_first_highest, true AS ends_by_rule, true AS loss_falls, true AS scores_agree FROM sides""",
)
def t3_patience(spark, sf):
    """What holds for the table of steps: one row a step, the best kept, the end by patience."""
    root, data = new_dir(spark, "descent"), labelled(spark, sf)
    model, steps = gd.fit_with_patience(data, root)
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ten rows or so
    seen = steps.withColumns({"top": F.max("f1").over(before), "n": F.row_number().over(before)})
    last = F.max_by(F.struct("step", "since_best"), "step")
    rules = seen.agg(
        F.every(F.col("step") == F.col("n") - 1).alias("in_order"),
        F.every((F.col("best_f1") == F.col("top")) & (F.col("step") - F.col("best_step") == F.col("since_best"))).alias("best_is_first_highest"),
        ((last["step"] == 10) | (last["since_best"] == 3)).alias("ends_by_rule"),
        (F.min_by("loss", "step") > F.max_by("loss", "step")).alias("loss_falls"),
        F.max("best_f1").alias("f1"),
    )
    test = cu.split(data.where("label is not null")).where("split = 'test'")
    hits = gd.linear_logits(model, test).select("label", (F.get("logits", F.lit(1)) > 0).alias("said"))
    counts = hits.agg(
        F.count("*").alias("held_out"), F.count_if(F.expr("label = 1")).alias("positives"),
        F.count_if(F.expr("label = 1 and said")).alias("tp"), F.count_if(F.expr("(label = 1) <> said")).alias("wrong"),
    )
    f1 = F.col("tp") * 2.0 / F.greatest(F.col("tp") * 2 + F.col("wrong"), F.lit(1))
    both = counts.join(rules, F.abs(f1 - F.col("f1")) < 1e-9, "left")
    return both.select("held_out", "positives", "in_order", "best_is_first_highest", "ends_by_rule", "loss_falls", F.col("f1").isNotNull().alias("scores_agree"))


@query("t3_restart", f"WITH {_SIDES} SELECT count(*) AS texts, true AS same_steps, true AS same_model FROM sides")
def t3_restart(spark, sf):
    """Training that stops after two steps and goes on is the training that never stopped."""
    data, roots = labelled(spark, sf), [new_dir(spark, "descent") for _ in range(2)]
    whole, steps = gd.fit_with_patience(data, roots[0], max_steps=4)
    gd.fit_with_patience(data, roots[1], max_steps=2)
    again, more = gd.fit_with_patience(data, roots[1], max_steps=4, resume=True)
    close = lambda a, b: bool(np.allclose(a, b, rtol=0, atol=1e-6))
    rows = [np.array([list(r) for r in x.orderBy("step").collect()], float) for x in (steps, more)]
    same = rows[0].shape == rows[1].shape and close(*rows)
    path = again.save(spark, new_dir(spark, "linear"))
    reread = gd.load_linear(spark, path)
    n = data.where("label is not null").agg(F.count("*").alias("texts"))
    return n.select("texts", F.lit(same).alias("same_steps"), F.lit(close(whole.weights, reread.weights)).alias("same_model"))


@query("t4_saved_model")
def t4(spark, sf):
    root = new_dir(spark, "models")
    data = labelled(spark, sf)
    tr.save_model(tr.fit_safety(data), root, "v1")
    model = tr.load_model(root, "v1")
    scored = tr.predict(model, data.withColumnRenamed("label", "y_true"))
    return ev.binary_metrics(scored)


@query("t4_reloaded_model", "SELECT count(*) AS texts, 0::BIGINT AS changed FROM documents")
def t4_reloaded(spark, sf):
    """A saved model, read again, gives every document the same probabilities."""
    root, docs = new_dir(spark, "models"), spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    model = tr.fit_safety(labelled(spark, sf))
    tr.save_model(model, root, "v1")
    before = tr.predict(model, docs).select("doc_id", "probs")
    after = tr.predict(tr.load_model(root, "v1"), docs).select("doc_id", F.col("probs").alias("again"))
    same = F.zip_with("probs", "again", lambda a, b: F.abs(a - b) < 1e-9)
    both = before.join(after, "doc_id")
    return both.agg(F.count("*").alias("texts"), F.count_if(~F.forall(same, lambda x: x)).alias("changed"))


@query("e19_functional_test")
def e19(spark, sf):
    # fitted on the labelled documents and the hand-written rows
    docs = labelled(spark, sf).select("text", F.col("label").cast("int").alias("label"))
    literals = cu.literal_examples(spark).withColumn("label", cu.to_binary("label"))
    return tr.functional_test(tr.fit_safety(cu.combine(docs, literals)), spark)


_EXAMPLES = ", ".join(f"({i}, '{e}')" for i, (_, e) in enumerate(FUNCTIONAL_EXAMPLES))


@query(
    "e19_functional_rules",
    f"""WITH x(example_id, expected) AS (VALUES {_EXAMPLES})
    SELECT example_id::INTEGER AS example_id, expected, true AS named, true AS agrees, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS learnt_from FROM x""",
)
def e19_rules(spark, sf):
    """What holds for each functional example whatever was learnt."""
    docs = labelled(spark, sf).select("text", F.col("label").cast("int").alias("label"))
    literals = cu.literal_examples(spark).withColumn("label", cu.to_binary("label"))
    done = tr.functional_test(tr.fit_safety(cu.combine(docs, literals)), spark)
    return done.select(
        "example_id", "expected", F.col("predicted").isin("SAFE", "UNSAFE").alias("named"),
        (F.col("ok") == (F.col("expected") == F.col("predicted"))).alias("agrees"), F.lit(docs.count()).cast("bigint").alias("learnt_from"),
    )


@query("t6_head_rules", "SELECT vec_id, label, 1.0::DOUBLE AS total, true AS is_argmax FROM embeddings")
def t6_head_rules(spark, sf):
    """What holds for each vector whatever the head has learnt."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = table(spark, sf, "embeddings")
    ready = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    scored = tr.fit_head(vectors, reg=0.01).transform(ready).withColumn("p", vector_to_array("probability"))
    total = F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9)
    return scored.select("vec_id", "label", total.alias("total"), (F.get("p", F.col("prediction").cast("int")) == F.array_max("p")).alias("is_argmax"))


_PLACED = """pl AS (
  SELECT vec_id AS id, label AS c, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) - 1 AS p FROM embeddings),
sz AS (SELECT c, count(*) AS n, sum(count(*)) OVER () - count(*) AS m,
  coalesce(sum(count(*)) OVER (ORDER BY md5(c::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pl GROUP BY 1),
g AS (SELECT id, c, p, n, m, before, before + p AS place FROM pl JOIN sz USING (c)),
w AS (SELECT *, unnest(range(1, 11)) AS r FROM g),
a AS (
  SELECT id, r, 1 AS same, before + (p + r) % n AS place FROM w WHERE r < n
  UNION ALL SELECT id, r, 0, x + CASE WHEN x < before THEN 0 ELSE n END
  FROM (SELECT *, (p + (r - 1) * greatest(m // 10, 1)) % m AS x FROM w WHERE r <= m)),
paired AS (SELECT a.id AS left_id, b.id AS right_id, a.r, a.same FROM a JOIN g b USING (place))"""


@query(
    "t5_contrastive_pairs",
    f"WITH {_PLACED} SELECT left_id, right_id, r::INTEGER AS iteration, same FROM paired",
)
def t5(spark, sf):
    return cu.contrastive_pairs(table(spark, sf, "embeddings"), 10, key="vec_id")


@query(
    "t5_classes_of_negatives",
    f"""WITH {_PLACED} SELECT x.c AS label, count(DISTINCT y.c) AS others, count(*) AS pairs FROM paired
    JOIN g x ON x.id = left_id JOIN g y ON y.id = right_id WHERE same = 0 GROUP BY 1""",
)
def t5_classes(spark, sf):
    """How many other classes the negatives of each class come from: all of them."""
    vectors = table(spark, sf, "embeddings")
    side = lambda name, out: vectors.select(F.col("vec_id").alias(name), F.col("label").alias(out))
    pairs = cu.contrastive_pairs(vectors, 10, key="vec_id").where("same = 0")
    both = pairs.join(side("left_id", "label"), "left_id").join(side("right_id", "other"), "right_id")
    return both.groupBy("label").agg(F.countDistinct("other").alias("others"), F.count("*").alias("pairs"))


@query(
    "t6_pair_scatter",
    f"""WITH {_PLACED}, d AS (
      SELECT same, list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) AS v
      FROM paired JOIN embeddings x ON x.vec_id = left_id JOIN embeddings y ON y.vec_id = right_id),
    ij AS (SELECT i, j FROM range(0, 64) a(i), range(0, 64) b(j) WHERE i <= j)
    SELECT same, i::INTEGER AS i, j::INTEGER AS j, round(sum(v[i + 1] * v[j + 1]), 4) AS total FROM d, ij GROUP BY ALL""",
)
def t6_scatter(spark, sf):
    vectors = table(spark, sf, "embeddings")
    pairs = cu.contrastive_pairs(vectors, 10, key="vec_id")
    sums = tr.pair_scatter(vectors, pairs, key="vec_id").where("i <= j")
    return sums.select("same", "i", "j", F.round("total", 4).alias("total"))


@query(
    "t6_contrastive_accuracy",
    """WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id)) AS k FROM embeddings)
    SELECT count(*) FILTER (k > (SELECT count(*) FROM embeddings) * 0.8) AS held_out, true AS not_below_raw FROM s""",
)
def t6_accuracy(spark, sf):
    """Centroids of projected vectors, fitted on four fifths, are no worse on the rest than raw ones."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    placed = with_hash_position(vectors.withColumn("_k", hash_key(42, "vec_id")), "_k", out="_at")
    marked = placed.withColumn("_test", F.col("_at") + 1 > F.lit(vectors.count() * 0.8))
    train, test = (marked.where(F.col("_test") == t).drop("_at", "_k", "_test") for t in (False, True))
    matrix = tr.whitening(tr.pair_scatter(train, cu.contrastive_pairs(train, 10, key="vec_id"), key="vec_id"))
    hits = []
    for project in (lambda v: v, lambda v: v.withColumn("embedding", tr.projected("embedding", matrix))):
        found = tr.nearest_centroid(project(test), tr.class_centroids(project(train)))
        hits.append(found.agg(F.count("*").alias("held_out"), F.count_if(F.col("predicted") == F.col("label")).alias("hits")))
    raw, own = hits[0].withColumnRenamed("hits", "raw"), hits[1]
    return own.join(raw, "held_out").select("held_out", (F.col("hits") >= F.col("raw")).alias("not_below_raw"))


_CENTROIDS = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2)"""


@query("t6_class_centroids", f"WITH {_CENTROIDS} SELECT label, (i - 1)::INTEGER AS dim, round(m, 6) AS mean FROM cen")
def t6(spark, sf):
    centroids = tr.class_centroids(table(spark, sf, "embeddings"))
    long = centroids.select("label", F.posexplode("centroid").alias("dim", "mean"))
    return long.withColumn("mean", F.round("mean", 6))


@query(
    "t6_nearest_centroid",
    f"""WITH {_CENTROIDS}, s AS (
      SELECT e.vec_id, cen.label, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) AS cosine
      FROM e JOIN cen ON cen.i = e.i GROUP BY 1, 2)
    SELECT vec_id, first(label ORDER BY cosine DESC, label) AS predicted, round(max(cosine), 6) AS cosine FROM s GROUP BY 1""",
)
def t6_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings")
    scored = tr.nearest_centroid(vectors, tr.class_centroids(vectors))
    return scored.select("vec_id", "predicted", F.round("cosine", 6).alias("cosine"))


@query("t6_logistic_head")
def t6_head(spark, sf):
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, sf, "embeddings")
    model = tr.fit_head(vectors, reg=0.01)
    ready = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return model.transform(ready).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"))
