"""Queries: hypotheses, label scores, verdicts, question and answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.constants import (
    CONCERNING_LABELS,
    DISPLAY_LABELS,
    HYPOTHESIS_DE,
    HYPOTHESIS_EN,
    LABELS_EN,
    LABEL_PRESETS,
    MAX_TOKENS,
)
from textveil.functions.arrays import unpack
from textveil.functions.scores import argmax, score_band, softmax
from textveil.functions.text import is_blank, truncate_tokens
from textveil.operators import classify as cl
from textveil.operators import prototypes as pr
from textveil.plans import corpus as co
from textveil.plans.registry import query, table

MENTAL = LABEL_PRESETS["mental_health"]


def r6(c):
    return F.round(c, 6)


@query(
    "c1_hypotheses",
    f"""WITH lab AS (SELECT unnest(range(0, {len(MENTAL)})) AS label_pos, unnest([{co.sql_list(MENTAL)}]) AS label)
    SELECT doc_id, label_pos::INTEGER AS label_pos, label, 'This text is about ' || label || '.' AS hypothesis, text
    FROM documents CROSS JOIN lab""",
)
def c1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cl.hypotheses(docs, MENTAL, HYPOTHESIS_EN)


@query(
    "c2_label_sets",
    f"""SELECT doc_id, list_aggregate(list_filter(
        [{co.sql_list(LABELS_EN)}] || CASE WHEN list_contains([{co.sql_list(LABELS_EN)}], lang) THEN [] ELSE [lang] END,
        lambda x: x <> 'neutral'), 'string_agg', '|') AS labels FROM documents""",
)
def c2(spark, sf):
    docs = table(spark, sf, "documents")
    base = F.array_union(cl.string_array(LABELS_EN), F.array("lang"))
    edited = cl.edit_labels(base, add=[" suicide "], remove=["neutral"])
    return docs.select("doc_id", F.array_join(edited, "|").alias("labels"))


@query(
    "c4_multi_label_scores",
    f"""WITH {co.sql_long(LABELS_EN)}
    SELECT doc_id, label, CASE WHEN blank THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(-x)), 6) END AS score FROM long""",
)
def c4(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(3))
    done = unpack(cl.classify(docs, LABELS_EN), "result", ["doc_id"])
    return done.select("doc_id", "label", r6(F.col("score")).alias("score"))


_SOFT = "soft AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY doc_id) AS s FROM long)"


@query(
    "c5_single_label_scores",
    f"""WITH {co.sql_long(MENTAL)}, {_SOFT}
    SELECT doc_id, label, CASE WHEN blank THEN 0.0::DOUBLE ELSE round(s, 6) END AS score FROM soft""",
)
def c5(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(5))
    done = unpack(cl.classify(docs, MENTAL, multi_label=False), "result", ["doc_id"])
    return done.select("doc_id", "label", r6(F.col("score")).alias("score"))


_RANK = """rk AS (SELECT doc_id, label, row_number() OVER (
  PARTITION BY doc_id ORDER BY CASE WHEN blank THEN 0 ELSE -x END, CASE WHEN blank THEN j END, label) AS rank FROM long)"""


@query("c6_ranked_labels", f"WITH {co.sql_long(MENTAL)}, {_RANK} SELECT doc_id, label, rank::INTEGER AS rank FROM rk")
def c6(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(5))
    done = unpack(cl.classify(docs, MENTAL), "result", ["doc_id"], "p")
    return done.select("doc_id", "label", (F.col("p") + 1).alias("rank"))


@query(
    "c6_rank_long_scores",
    f"""WITH {co.sql_long(MENTAL)} SELECT doc_id, label, round(x, 6) AS score,
        row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, label)::INTEGER AS rank FROM long""",
)
def c6_long(spark, sf):
    docs = table(spark, sf, "documents").withColumn("logits", co.logits(5))
    scored = docs.select("doc_id", F.explode(F.arrays_zip(cl.string_array(MENTAL).alias("label"), F.col("logits").alias("score"))).alias("z"))
    ranked = cl.rank_labels(scored.select("doc_id", "z.label", "z.score"))
    return ranked.withColumn("score", r6(F.col("score")))


@query(
    "c7_top_label",
    f"""WITH {co.sql_long(MENTAL)}, {_RANK}
    SELECT l.doc_id, l.label AS top_label, CASE WHEN blank THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(-x)), 6) END AS top_score
    FROM long l JOIN rk ON rk.doc_id = l.doc_id AND rk.label = l.label WHERE rank = 1""",
)
def c7(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(5))
    done = cl.classify(docs, MENTAL)
    return done.select("doc_id", cl.top_label("result").alias("top_label"), r6(cl.top_score("result")).alias("top_score"))


_DISPLAY = f"""disp AS (SELECT unnest([{co.sql_list(DISPLAY_LABELS)}]) AS k, unnest([{co.sql_list(DISPLAY_LABELS.values())}]) AS v)"""


@query(
    "c8_display_labels",
    f"""WITH lab AS (SELECT unnest([{co.sql_list([*DISPLAY_LABELS, 'other'])}]) AS label, unnest(range(0, {len(DISPLAY_LABELS) + 1})) AS j),
    {_DISPLAY} SELECT d.doc_id, lab.label, coalesce(v, lab.label) AS display_label
    FROM documents d JOIN lab ON lab.j = d.doc_id % {len(DISPLAY_LABELS) + 1} LEFT JOIN disp ON k = lab.label""",
)
def c8(spark, sf):
    labels = [*DISPLAY_LABELS, "other"]
    label = F.get(cl.string_array(labels), F.pmod("doc_id", F.lit(len(labels))).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", label.alias("label"))
    return docs.withColumn("display_label", cl.display("label"))


@query(
    "c9_blank_texts",
    f"""WITH {co.sql_long(LABELS_EN)} SELECT doc_id, string_agg(label, '|' ORDER BY CASE WHEN blank THEN 0 ELSE -x END, CASE WHEN blank THEN j END, label) AS labels,
        max(CASE WHEN blank THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(-x)), 6) END) AS top FROM long GROUP BY 1""",
)
def c9(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(3))
    done = cl.classify(docs, LABELS_EN)
    labels = F.array_join(F.transform("result", lambda e: e.label), "|")
    return done.select("doc_id", labels.alias("labels"), r6(cl.top_score("result")).alias("top"))


@query(
    "c10_inference_probs",
    f"""WITH {co.sql_long(['contradiction', 'neutral', 'entailment'])}, {_SOFT}
    SELECT doc_id, round(max(s) FILTER (j = 0), 6) AS contradiction, round(max(s) FILTER (j = 1), 6) AS neutral,
           round(max(s) FILTER (j = 2), 6) AS entailment FROM soft GROUP BY 1""",
)
def c10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", cl.nli_probs(co.logits(3)).alias("p"))
    return docs.select("doc_id", *[r6(F.col(f"p.{n}")).alias(n) for n in ("contradiction", "neutral", "entailment")])


@query(
    "c11_contrast_score",
    f"""WITH {co.sql_long(['primary', 'alternative'])}, {_SOFT}
    SELECT doc_id, CASE WHEN blank THEN 0.0::DOUBLE ELSE round(s, 6) END AS score FROM soft WHERE label = 'primary'""",
)
def c11(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(2))
    done = cl.classify(docs, ["primary", "alternative"], multi_label=False)
    return done.select("doc_id", r6(cl.contrast_score("result", "primary")).alias("score"))


_TWO = f"two AS (SELECT doc_id, text, {co.sql_logit('0')} AS a, {co.sql_logit('1')} AS b FROM documents)"
_PROBS = "pr AS (SELECT *, exp(a) / (exp(a) + exp(b)) AS safe_p, exp(b) / (exp(a) + exp(b)) AS unsafe_p FROM two)"


@query(
    "c12_binary_label",
    f"""WITH {_TWO}, {_PROBS} SELECT doc_id, CASE WHEN b > a THEN 'UNSAFE' ELSE 'SAFE' END AS label,
        round(safe_p, 6) AS safe_prob, round(unsafe_p, 6) AS unsafe_prob FROM pr""",
)
def c12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", cl.binary_label(co.logits(2)).alias("b"))
    return docs.select("doc_id", "b.label", r6(F.col("b.safe_prob")).alias("safe_prob"), r6(F.col("b.unsafe_prob")).alias("unsafe_prob"))


@query(
    "c13_confidence",
    f"""WITH {_TWO}, {_PROBS} SELECT doc_id, CASE WHEN b > a THEN 'UNSAFE' ELSE 'SAFE' END AS label,
        CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE round(greatest(safe_p, unsafe_p), 6) END AS confidence FROM pr""",
)
def c13(spark, sf):
    docs = table(spark, sf, "documents").withColumn("logits", co.logits(2))
    docs = docs.select(
        "doc_id",
        argmax("logits").alias("label_id"),
        F.when(F.col("doc_id") % 3 != 0, softmax("logits")).alias("probs"),
    )
    done = cl.with_confidence(docs)
    return done.select("doc_id", "label", r6(F.col("confidence")).alias("confidence"))


@query(
    "c14_single_hypothesis",
    f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(-{co.sql_logit('0')})), 6) END AS score FROM documents",
)
def c14(spark, sf):
    docs = co.classified_docs(spark, sf)
    return docs.select("doc_id", r6(cl.hypothesis_score("text", F.get(co.logits(1), F.lit(0)))).alias("score"))


@query(
    "c15_score_bands",
    """SELECT CASE WHEN value / 100 < 0.4 THEN 'low' WHEN value / 100 < 0.7 THEN 'medium' ELSE 'high' END AS band,
       count(*) AS n FROM events GROUP BY 1""",
)
def c15(spark, sf):
    events = table(spark, sf, "events").select(score_band(F.col("value") / 100).alias("band"))
    return events.groupBy("band").agg(F.count("*").alias("n"))


@query(
    "c16_content_alerts",
    f"""WITH {co.sql_long(MENTAL)} SELECT doc_id, count(*)::INTEGER AS alerts, string_agg(label, '|' ORDER BY label) AS labels FROM long
    WHERE NOT blank AND label IN ({co.sql_list(CONCERNING_LABELS)}) AND 1.0 / (1.0 + exp(-x)) > 0.5 GROUP BY 1""",
)
def c16(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(5))
    alerts = cl.classify(docs, MENTAL).select("doc_id", cl.content_alert("result").alias("a"))
    labels = F.array_join(F.array_sort(F.transform("a", lambda e: e.label)), "|")
    return alerts.select("doc_id", F.size("a").alias("alerts"), labels.alias("labels")).where("alerts > 0")


@query("c17_unsafe_rows", f"WITH {_TWO} SELECT doc_id, text FROM two WHERE b > a")
def c17(spark, sf):
    docs = table(spark, sf, "documents").withColumn("label", cl.binary_label(co.logits(2))["label"])
    return cl.unsafe_rows(docs).select("doc_id", "text")


_PAIRS = """pairs AS (
  SELECT * FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(text) OVER w AS answer, lead(role) OVER w AS next_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


@query("c22_question_answer_pairs", f"WITH {_PAIRS} SELECT conv_id, turn, question, answer FROM pairs")
def c22(spark, sf):
    return cl.qa_pairs(table(spark, sf, "conversations"))


@query("c18_qa_text", f"WITH {_PAIRS} SELECT conv_id, turn, 'Frage: ' || question || ' Antwort: ' || answer AS qa FROM pairs")
def c18(spark, sf):
    pairs = cl.qa_pairs(table(spark, sf, "conversations"))
    return pairs.select("conv_id", "turn", cl.qa_text("question", "answer").alias("qa"))


_QA_LOGITS = """lg AS (
  SELECT *, (conv_id + turn) % 7 = 0 AS blank,
         ((conv_id * 3 + turn * 5) % 11)::DOUBLE / 5.0 AS a, ((conv_id * 2 + turn * 7) % 13)::DOUBLE / 6.0 AS b FROM pairs)"""


def _qa_scored(spark, sf, n=2):
    pairs = cl.qa_pairs(table(spark, sf, "conversations"))
    a = F.pmod(F.col("conv_id") * 3 + F.col("turn") * 5, F.lit(11)).cast("double") / 5.0
    b = F.pmod(F.col("conv_id") * 2 + F.col("turn") * 7, F.lit(13)).cast("double") / 6.0
    blank = (F.col("conv_id") + F.col("turn")) % 7 == 0
    return pairs.withColumn("answer", F.when(blank, F.lit("  ")).otherwise(F.col("answer"))).withColumn(
        "logits", F.array(a, b, *[F.lit(0.25)] * (n - 2))
    )


def _verdict_columns(df):
    return df.select(
        "conv_id", "turn", "is_relevant",
        r6(F.col("relevance_score")).alias("relevance_score"),
        r6(F.col("irrelevance_score")).alias("irrelevance_score"),
        "verdict",
    )


_VERDICT = """SELECT conv_id, turn, NOT blank AND rel >= {t} AS is_relevant,
  CASE WHEN blank THEN 0.0::DOUBLE ELSE round(rel, 6) END AS relevance_score,
  CASE WHEN blank THEN 1.0::DOUBLE ELSE round(irr, 6) END AS irrelevance_score,
  CASE WHEN NOT blank AND rel >= {t} THEN 'relevant' ELSE 'off-topic' END AS verdict FROM v"""


@query(
    "c19_relevance_verdict",
    f"""WITH {_PAIRS}, {_QA_LOGITS}, v AS (SELECT *, exp(a) / (exp(a) + exp(b)) AS rel, exp(b) / (exp(a) + exp(b)) AS irr FROM lg)
    {_VERDICT.format(t=0.5)}""",
)
def c19(spark, sf):
    return _verdict_columns(cl.relevance(_qa_scored(spark, sf)))


@query(
    "c20_relevance_markers",
    f"""WITH {_PAIRS}, {_QA_LOGITS}, z AS (SELECT *, exp(a) + exp(b) + exp(0.25) AS t FROM lg),
    v AS (SELECT *, least(exp(a), exp(b)) / t AS rel, exp(0.25) / t AS irr FROM z)
    {_VERDICT.format(t=0.3)}""",
)
def c20(spark, sf):
    # two labels carry a marker; the lower-ranked one gives the score
    labels = ["SINNVOLL", "irrelevant", "Unsinn"]
    return _verdict_columns(cl.relevance(_qa_scored(spark, sf, 3), labels=labels, threshold=0.3))


@query(
    "c21_blank_answers",
    f"""WITH {_PAIRS}, {_QA_LOGITS} SELECT CASE WHEN blank THEN 'blank' ELSE 'text' END AS kind,
        count(*) FILTER (NOT blank AND exp(a) / (exp(a) + exp(b)) >= 0.5) AS relevant, count(*) AS n FROM lg GROUP BY 1""",
)
def c21(spark, sf):
    done = cl.relevance(_qa_scored(spark, sf))
    kind = F.when(is_blank("answer"), "blank").otherwise("text")
    return done.groupBy(kind.alias("kind")).agg(F.count_if("is_relevant").alias("relevant"), F.count("*").alias("n"))


@query(
    "c23_truncated_tokens",
    f"""WITH s AS (SELECT doc_id, string_split({co.sql_squash('text')}, ' ') AS t FROM documents)
    SELECT doc_id, array_to_string(t[1:{MAX_TOKENS}], ' ') AS text FROM s""",
)
def c23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_tokens("text").alias("text"))


@query(
    "c24_result_records",
    f"""WITH {co.sql_long(LABELS_EN)} SELECT doc_id, first(label ORDER BY CASE WHEN blank THEN 0 ELSE -x END, CASE WHEN blank THEN j END, label) AS top_label,
        count(*)::INTEGER AS n_labels, true AS multi_label FROM long GROUP BY 1""",
)
def c24(spark, sf):
    docs = co.classified_docs(spark, sf).withColumn("logits", co.logits(3))
    records = cl.to_result(cl.classify(docs, LABELS_EN))
    back = F.from_json("record", "text string, labels array<string>, top_label string, multi_label boolean")
    return records.select("doc_id", back.alias("r")).select("doc_id", "r.top_label", F.size("r.labels").alias("n_labels"), "r.multi_label")


@query(
    "c3_batch_scorer",
    f"""WITH lab AS (SELECT unnest([{co.sql_list(LABELS_EN)}]) AS label),
    d AS (SELECT doc_id, doc_id % 10 = 0 AS blank, text, label, 'This text is about ' || label || '.' AS h FROM documents CROSS JOIN lab)
    SELECT doc_id, label, CASE WHEN blank THEN NULL ELSE ((length(text) + length(h)) % 17)::DOUBLE / 4.0 END AS logit FROM d""",
)
def c3(spark, sf):
    def load_scorer():
        # stands for loading a model; once per task
        return lambda texts, hyps: [[(len(t) + len(h)) % 17 / 4.0 for h in hs] for t, hs in zip(texts, hyps)]

    docs = co.classified_docs(spark, sf).select("doc_id", "text")
    scored = cl.score(docs, load_scorer, LABELS_EN, template=HYPOTHESIS_EN)
    filled = F.coalesce("logits", F.array_repeat(F.lit(None).cast("double"), len(LABELS_EN)))
    long = scored.select("doc_id", F.posexplode(filled).alias("j", "logit"))
    return long.select("doc_id", F.get(cl.string_array(LABELS_EN), F.col("j")).alias("label"), "logit")


@query(
    "c3_relevance_scorer",
    f"""WITH {_PAIRS}, z AS (SELECT *, length('Frage: ' || question || ' Antwort: ' || answer) AS n, false AS blank FROM pairs),
    lg AS (SELECT *, exp((n % 7)::DOUBLE / 3.0) AS ea, exp((n % 5)::DOUBLE / 2.0) AS eb FROM z),
    v AS (SELECT *, ea / (ea + eb) AS rel, eb / (ea + eb) AS irr FROM lg)
    {_VERDICT.format(t=0.5)}""",
)
def c3_relevance(spark, sf):
    def load_scorer():
        return lambda texts, hyps: [[len(t) % 7 / 3.0, len(t) % 5 / 2.0] for t in texts]

    pairs = cl.qa_pairs(table(spark, sf, "conversations"))
    return _verdict_columns(cl.check_relevance(pairs, load_scorer))


@query(
    "p17_scrub_and_classify",
    f"""{co.PROBE.replace('probe AS', 'WITH probe AS', 1)}, {co.DICTIONARIES}, {_TWO},
    r AS (SELECT doc_id, {co.sql_rules()} AS text FROM probe),
    m AS (SELECT doc_id, array_to_string(list_transform(string_split({co.sql_squash('text')}, ' '), lambda t:
      CASE WHEN list_contains(ns, {co.sql_norm('t')}) THEN '[PERSON]' ELSE t END), ' ') AS text FROM r, dict)
    SELECT m.doc_id, p.text, regexp_replace(m.text, '\\p{{Nd}}{{3,}}', '[NUM]', 'g') AS scrubbed,
      CASE WHEN b > a THEN 'UNSAFE' ELSE 'SAFE' END AS label
    FROM m JOIN two ON two.doc_id = m.doc_id JOIN probe p ON p.doc_id = m.doc_id""",
)
def p17(spark, sf):
    docs = co.probe(spark, sf, "n_chars").withColumn("logits", co.logits(2))
    done = cl.scrub_and_classify(docs, names=co.names(spark, sf))
    return done.select("doc_id", "text", "scrubbed", "label")




# --- scores from the texts' own words ----------------------------------------

_PROFILE = r"""tx AS (SELECT DISTINCT text FROM documents WHERE regexp_matches(text, '[^\s]')),
dfs AS (SELECT w AS word, count(*) AS df FROM (SELECT DISTINCT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM tx) GROUP BY 1),
nt AS (SELECT count(*) AS n FROM tx),
ex_w AS (SELECT label, text, word, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0))) + 1) AS w
  FROM (SELECT label, text, w AS word, count(*)::DOUBLE AS tf FROM (SELECT DISTINCT label, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS i FROM ex) GROUP BY 1, 2, 3)
  LEFT JOIN dfs USING (word), nt),
ex_n AS (SELECT label, text, sqrt(sum(w * w)) AS len FROM ex_w GROUP BY 1, 2),
times AS (SELECT label, text, count(*) AS times FROM ex GROUP BY 1, 2),
raw AS (SELECT label, word, sum(w / len * times) AS p FROM ex_w JOIN ex_n USING (label, text) JOIN times USING (label, text) GROUP BY 1, 2),
proto AS (SELECT label, word, p / sqrt(sum(p * p) OVER (PARTITION BY label)) AS p FROM raw),
tx_w AS (SELECT text, word, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0))) + 1) AS w
  FROM (SELECT text, w AS word, count(*)::DOUBLE AS tf FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM tx) GROUP BY 1, 2) LEFT JOIN dfs USING (word), nt),
tx_n AS (SELECT text, sqrt(sum(w * w)) AS len FROM tx_w GROUP BY 1),
cosines AS (SELECT text, label, sum(w * p) / any_value(len) AS cosine FROM tx_w JOIN proto USING (word) JOIN tx_n USING (text) GROUP BY 1, 2)"""
_BY_LANG = f"ex AS (SELECT lang AS label, text FROM documents), {_PROFILE}"
LANGS = ["de", "en", "es", "fr"]


def lang_scored(spark, sf):
    """Documents with a logit for each language, from prototypes of all documents of it."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    vocabulary = pr.fit_vocabulary(docs)
    prototypes = pr.fit_prototypes(docs, vocabulary, "lang")
    return pr.prototype_logits(docs, LANGS, prototypes, vocabulary)


@query(
    "c3_label_scores",
    f"""WITH {_BY_LANG}, lab AS (SELECT unnest([{co.sql_list(LANGS)}]) AS label)
    SELECT doc_id, lab.label, round(10 * coalesce(cosine, 0), 5) AS logit
    FROM documents d CROSS JOIN lab LEFT JOIN cosines c ON c.text = d.text AND c.label = lab.label""",
)
def c3_labels(spark, sf):
    done = lang_scored(spark, sf).select("doc_id", F.explode(F.arrays_zip(cl.string_array(LANGS).alias("label"), F.col("logits").alias("x"))).alias("z"))
    return done.select("doc_id", "z.label", F.round("z.x", 5).alias("logit"))


@query(
    "c4_scores_from_text",
    f"""WITH {_BY_LANG}, lab AS (SELECT unnest([{co.sql_list(LANGS)}]) AS label)
    SELECT doc_id, lab.label, round(CASE WHEN regexp_matches(d.text, '[^\\s]') THEN 1 / (1 + exp(-10 * coalesce(cosine, 0))) ELSE 0 END, 5) AS score
    FROM documents d CROSS JOIN lab LEFT JOIN cosines c ON c.text = d.text AND c.label = lab.label""",
)
def c4_text(spark, sf):
    done = unpack(cl.classify(lang_scored(spark, sf), LANGS), "result", ["doc_id"])
    return done.select("doc_id", "label", F.round("score", 5).alias("score"))


_BY_TOXIC = f"ex AS (SELECT toxic AS label, text FROM documents JOIN labels USING (doc_id)), {_PROFILE}"


@query(
    "c11_safety_from_text",
    f"""WITH {_BY_TOXIC}, two AS (
      SELECT doc_id, coalesce(max(cosine) FILTER (label = 0), 0) AS a, coalesce(max(cosine) FILTER (label = 1), 0) AS b
      FROM documents d LEFT JOIN cosines c ON c.text = d.text GROUP BY 1)
    SELECT doc_id, CASE WHEN b > a THEN 'UNSAFE' ELSE 'SAFE' END AS label, round(1 / (1 + exp(10 * (a - b))), 5) AS unsafe_prob FROM two""",
)
def c11_text(spark, sf):
    """SAFE or UNSAFE by prototypes of the labelled documents of each kind."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    vocabulary = pr.fit_vocabulary(docs)
    scored = pr.prototype_logits(docs, [0, 1], pr.fit_prototypes(known, vocabulary), vocabulary)
    verdict = cl.binary_label("logits")
    return scored.select("doc_id", verdict["label"].alias("label"), F.round(verdict["unsafe_prob"], 5).alias("unsafe_prob"))


@query(
    "c3_best_hypothesis",
    f"""WITH ex AS (SELECT item_id AS label, text FROM benchmark), {_PROFILE},
    best AS (SELECT text, label, cosine FROM cosines QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(cosine, 9) DESC, label) = 1)
    SELECT doc_id, round(cosine, 5) AS cosine FROM documents JOIN best USING (text)""",
)
def c3_hypothesis(spark, sf):
    """Each document's best of all benchmark passages, taken as hypotheses."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocabulary = pr.fit_vocabulary(docs)
    prototypes = pr.fit_prototypes(table(spark, sf, "benchmark"), vocabulary, "item_id")
    return pr.best_hypotheses(docs, prototypes, vocabulary).select("doc_id", F.round("cosine", 5).alias("cosine"))


@query(
    "c1_hypotheses_de",
    f"""WITH lab AS (SELECT unnest(range(0, {len(LABEL_PRESETS['default_de'])})) AS label_pos, unnest([{co.sql_list(LABEL_PRESETS['default_de'])}]) AS label)
    SELECT doc_id, label_pos::INTEGER AS label_pos, {"'" + HYPOTHESIS_DE.partition("{}")[0] + "' || label || '" + HYPOTHESIS_DE.partition("{}")[2] + "'"} AS hypothesis
    FROM documents CROSS JOIN lab""",
)
def c1_de(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return cl.hypotheses(docs, LABEL_PRESETS["default_de"], HYPOTHESIS_DE).select("doc_id", "label_pos", "hypothesis")
