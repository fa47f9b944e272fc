"""Queries: building labelled training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.constants import (
    CLINICAL_SCENARIOS,
    HARD_UNSAFE_TEXTS,
    OUTPUT_LENGTHS,
    REPAIR_EXAMPLES,
    SAFETY_IDS,
    SYNTHETIC_SCENARIOS,
    TRICKY_SCENARIOS,
)
from textveil.functions.text import preview, strip_quotes
from textveil.operators import curate as cu
from textveil.operators.classify import string_array
from textveil.plans import corpus as co
from textveil.plans.registry import query, spread, table
from textveil.sources import tables as st
from textveil.sources.words import read_deny_list, write_deny_list
from textveil.sources.workspace import new_dir

CLASSES = ["suicide", "non-suicide"]


def classed(spark, sf):
    """Documents with a class derived from their id."""
    cls = F.when(F.col("doc_id") % 3 == 0, CLASSES[0]).otherwise(CLASSES[1])
    return table(spark, sf, "documents").withColumn("class", cls)


CLASSED = "classed AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'suicide' ELSE 'non-suicide' END AS class FROM documents)"
KEY = "md5('42:' || doc_id)"


def safety(spark, sf):
    """Labelled documents, toxic ones UNSAFE."""
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "UNSAFE").otherwise("SAFE").alias("label"))
    return table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")


SAFETY = """safety AS (
  SELECT d.doc_id, d.text, CASE WHEN toxic = 1 THEN 'UNSAFE' ELSE 'SAFE' END AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

# --- sinks and sources, written and read back -------------------------------

_DOCS_LABELLED = "SELECT text, lang AS label, source, CASE WHEN doc_id % 4 = 0 THEN text END AS source_text FROM documents"


def _labelled(spark, sf):
    src = F.when(F.col("doc_id") % 4 == 0, F.col("text"))
    return table(spark, sf, "documents").select("text", F.col("lang").alias("label"), "source", src.alias("source_text"))


@query("s6_labelled_csv", _DOCS_LABELLED)
def s6(spark, sf):
    path = new_dir(spark, "labelled")
    st.append_examples(_labelled(spark, sf), path)
    return st.read_labelled(spark, path)


@query("s8_append_examples", f"{_DOCS_LABELLED} UNION ALL {_DOCS_LABELLED}")
def s8(spark, sf):
    path = new_dir(spark, "appended")
    st.append_examples(_labelled(spark, sf), path)
    st.append_examples(_labelled(spark, sf), path)
    return st.read_labelled(spark, path)


@query("s9_score_sink", f"WITH {co.SCORED_DOCS} SELECT doc_id, text, category, y_true, score AS hypothesis_score FROM scored")
def s9(spark, sf):
    scored = co.scored_docs(spark, sf)
    path = st.write_scores(scored, "score", new_dir(spark, "scores"), "documents")
    written = "doc_id bigint, text string, category string, y_true int, score double, hypothesis_score double"
    return st.read_labelled(spark, path, written).select(
        "doc_id", "text", "category", "y_true", "hypothesis_score"
    )


@query("s10_training_set_sink", f"WITH {SAFETY} SELECT text, (label = 'UNSAFE')::INTEGER AS label FROM safety")
def s10(spark, sf):
    path = new_dir(spark, "training")
    rows = safety(spark, sf).select("text", cu.to_binary("label").alias("label"))
    st.write_training_set(rows, path)
    return st.read_labelled(spark, path, st.TRAINING)


@query("s5_deny_list_write", "SELECT row_number() OVER (ORDER BY n_name) - 1 AS ord, n_name AS term FROM nation")
def s5(spark, sf):
    nations = table(spark, sf, "nation")
    path = new_dir(spark, "deny")
    write_deny_list(nations.select(F.col("n_name").alias("ord"), F.col("n_name").alias("term")), path)
    return read_deny_list(spark, path).select(F.col("ord").cast("bigint").alias("ord"), "term")


@query("s12_required_columns", "SELECT doc_id, text FROM documents")
def s12(spark, sf):
    return st.require_columns(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "text")


@query("s13_output_locations", "SELECT lang AS label, count(*) AS n, 'german_safety_v2_' || lang AS location FROM documents GROUP BY lang")
def s13(spark, sf):
    modes = table(spark, sf, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    prefix = st.dataset_path("", "v2", "").lstrip("/")
    return modes.withColumn("location", F.concat(F.lit(prefix), F.col("label")))


# --- filters and samples ----------------------------------------------------


@query("d1_short_texts", "SELECT doc_id, text FROM documents WHERE length(text) < 350")
def d1(spark, sf):
    return cu.short_texts(table(spark, sf, "documents")).select("doc_id", "text")


_TOP = f"rn AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {KEY}) AS r FROM classed)"


@query("d2_balanced_sample", f"WITH {CLASSED}, {_TOP} SELECT doc_id, class, text FROM rn WHERE r <= 100")
def d2(spark, sf):
    return cu.balanced_sample(classed(spark, sf), "class", 100).select("doc_id", "class", "text")


@query(
    "d2_large_balanced_sample",
    f"WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS flag FROM lineitem), "
    f"rn AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5('42:' || id)) AS r FROM c) SELECT id, flag FROM rn WHERE r <= 5000",
)
def d2_large(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flag")
    )
    return cu.balanced_sample(rows, "flag", 5000, key="id")


@query(
    "d3_concatenated_samples",
    f"WITH {CLASSED}, {_TOP} SELECT doc_id, class FROM rn WHERE (class = 'suicide' AND r <= 50) OR (class = 'non-suicide' AND r <= 70)",
)
def d3(spark, sf):
    docs = classed(spark, sf)
    parts = [cu.sample_n(docs.where(F.col("class") == c), n) for c, n in zip(CLASSES, (50, 70))]
    return cu.combine(*parts).select("doc_id", "class")


@query("d4_class_labels", f"WITH {CLASSED} SELECT doc_id, CASE WHEN class = 'suicide' THEN 'UNSAFE' ELSE 'SAFE' END AS label FROM classed")
def d4(spark, sf):
    return classed(spark, sf).select("doc_id", cu.map_class("class").alias("label"))


@query(
    "d5_pending_rows",
    """SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0 AND text <> '')""",
)
def d5(spark, sf):
    docs = table(spark, sf, "documents")
    source_text = F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise(F.lit(""))
    done = docs.where("lang = 'en'").select(source_text.alias("source_text"))
    return cu.pending(docs, done).select("doc_id")


@query(
    "d6_new_texts",
    """WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1)
    SELECT doc_id, text FROM f WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'fr')""",
)
def d6(spark, sf):
    docs = table(spark, sf, "documents")
    return cu.new_only(docs, docs.where("lang = 'fr'")).select("doc_id", "text")


@query("d6_distinct_texts", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def d6_batch(spark, sf):
    return cu.new_only(table(spark, sf, "documents")).select("doc_id", "text")


@query("d7_cap", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 200")
def d7(spark, sf):
    return cu.cap(table(spark, sf, "documents"), 200, "doc_id").select("doc_id", "text")


@query("d12_valid_examples", "SELECT doc_id, lang, text FROM documents WHERE lang IN ('de', 'fr') AND text <> ''")
def d12(spark, sf):
    return cu.valid_examples(table(spark, sf, "documents"), ["de", "fr"], label="lang").select("doc_id", "lang", "text")


@query("d15_unsafe_class", f"WITH {SAFETY} SELECT doc_id, text FROM safety WHERE label = 'UNSAFE'")
def d15(spark, sf):
    return safety(spark, sf).where("label = 'UNSAFE'").select("doc_id", "text")


@query("d16_sample", f"SELECT doc_id, text FROM documents ORDER BY {KEY} LIMIT 100")
def d16(spark, sf):
    return cu.sample_n(table(spark, sf, "documents"), 100).select("doc_id", "text")


@query("d16_large_sample", "SELECT event_id, user_id FROM events ORDER BY md5('42:' || event_id) LIMIT 4000")
def d16_large(spark, sf):
    return cu.sample_n(table(spark, sf, "events"), 4000, key="event_id").select("event_id", "user_id")


@query("d26_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {KEY}) - 1 AS position FROM documents")
def d26(spark, sf):
    from textveil.functions.text import hash_key
    from textveil.operators.ranking import with_hash_position

    docs = table(spark, sf, "documents").select("doc_id", hash_key(42, "doc_id").alias("k"))
    return with_hash_position(docs, "k").select("doc_id", "position")


@query("d26_shuffled_rows", "SELECT doc_id, text FROM documents")
def d26_rows(spark, sf):
    return cu.shuffle(table(spark, sf, "documents")).select("doc_id", "text")


@query("d28_split", f"SELECT doc_id, CASE WHEN substr({KEY}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM documents")
def d28(spark, sf):
    return cu.split(table(spark, sf, "documents")).select("doc_id", "split")


@query("d33_random_example", f"SELECT doc_id, text FROM documents ORDER BY {KEY} LIMIT 1")
def d33(spark, sf):
    return cu.sample_n(table(spark, sf, "documents"), 1).select("doc_id", "text")


# --- assignment and requests ------------------------------------------------


@query(
    "d8_round_robin",
    f"""SELECT event_id, ([{co.sql_list(OUTPUT_LENGTHS)}])[(row_number() OVER (ORDER BY event_id) - 1) % {len(OUTPUT_LENGTHS)} + 1] AS length_instruction
    FROM events""",
)
def d8(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return cu.round_robin(events, OUTPUT_LENGTHS, "event_id", "length_instruction")


_CELLS = [("clinical", s, n) for s in CLINICAL_SCENARIOS for n in OUTPUT_LENGTHS] + [
    ("tricky", s, n) for s in TRICKY_SCENARIOS for n in OUTPUT_LENGTHS
]
_GRID = "grid(request_id, kind, scenario, length) AS (VALUES " + ", ".join(
    f"({i}, {co.sql_list(c)})" for i, c in enumerate(_CELLS)
) + ")"


@query(
    "d9_prompt_grid",
    f"""WITH {_GRID}, u AS (SELECT doc_id % {len(_CELLS)} AS request_id, count(*) AS examples FROM documents GROUP BY 1)
    SELECT g.request_id::INTEGER AS request_id, kind, scenario, length, coalesce(examples, 0) AS examples
    FROM grid g LEFT JOIN u ON u.request_id = g.request_id""",
)
def d9(spark, sf):
    grid = cu.prompt_grid(spark)
    docs = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(len(_CELLS))).cast("int").alias("request_id"))
    counts = docs.groupBy("request_id").agg(F.count("*").alias("examples"))
    return grid.join(counts, "request_id", "left").fillna(0, ["examples"])


@query(
    "d10_prompts",
    f"""WITH s AS (SELECT doc_id, text, ([{co.sql_list(SYNTHETIC_SCENARIOS)}])[doc_id % {len(SYNTHETIC_SCENARIOS)} + 1] AS scenario FROM documents)
    SELECT doc_id, 'Write five SAFE and five UNSAFE diary lines as JSON. ' || scenario AS synthetic, text AS translate FROM s""",
)
def d10(spark, sf):
    scenario = F.get(string_array(SYNTHETIC_SCENARIOS), F.pmod("doc_id", F.lit(len(SYNTHETIC_SCENARIOS))).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", "text", scenario.alias("scenario"))
    docs = cu.render_prompts(docs, "synthetic", "synthetic", scenario="scenario")
    return cu.render_prompts(docs, "translate", "translate", text="text").select("doc_id", "synthetic", "translate")


@query(
    "d10_answer_prompts",
    """SELECT conv_id, turn, 'Übung: c' || conv_id || chr(10) || 'Abschnitt: ' || role || chr(10) || 'Zu beantworten: ' || text || chr(10) || 'Umfang: MAXIMAL 5 Wörter.' AS prompt
      FROM conversations""",
)
def d10_answers(spark, sf):
    turns = table(spark, sf, "conversations")
    exercise = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    done = cu.render_prompts(turns, "answer", exercise=exercise, text="role", question="text", length=F.lit(OUTPUT_LENGTHS[0]))
    return done.select("conv_id", "turn", "prompt")


@query(
    "d10_twin_requests",
    """SELECT doc_id, 'Write a harmless line in the style of the one below, as JSON with the key twin_text.' || chr(10) || text AS prompt
    FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
)
def d10_twins(spark, sf):
    """A request for a harmless twin of each text that is labelled unsafe."""
    unsafe = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf, "documents").join(unsafe, "doc_id")
    return cu.render_prompts(docs, "twin", text="text").select("doc_id", "prompt")


@query(
    "d10_grid_requests",
    f"""WITH {_GRID} SELECT doc_id, kind, scenario || CASE kind WHEN 'clinical' THEN ' Schreibe drei Zeilen je Label als JSON.'
      ELSE ' Schreibe drei harmlose Zeilen als JSON.' END || ' Umfang: ' || length AS prompt
    FROM documents JOIN grid ON request_id = doc_id % {len(_CELLS)}""",
)
def d10_grid(spark, sf):
    """The clinical and the tricky requests, one for each document in turn."""
    docs = table(spark, sf, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(_CELLS))).cast("int").alias("request_id"))
    cells = docs.join(F.broadcast(cu.prompt_grid(spark)), "request_id")
    parts = [cu.render_prompts(cells.where(F.col("kind") == k), k, scenario="scenario", length="length") for k in ("clinical", "tricky")]
    return parts[0].unionByName(parts[1]).select("doc_id", "kind", "prompt")


@query(
    "d14_batches",
    """WITH n AS (SELECT count(*) AS n FROM documents)
    SELECT b::INTEGER AS batch, least(10, n - b * 10)::BIGINT AS size FROM (SELECT n, unnest(range(0, ((n + 9) // 10)::BIGINT)) AS b FROM n)""",
)
def d14(spark, sf):
    return cu.batches(spark, table(spark, sf, "documents").count())


# --- responses --------------------------------------------------------------


def responses(spark, sf):
    """Documents dressed as model responses, some of them broken."""
    docs = table(spark, sf, "documents")
    pair = F.array(
        F.struct(F.col("text").alias("text"), F.lit("UNSAFE").alias("label")),
        F.struct(F.col("lang").alias("text"), F.lit("SAFE").alias("label")),
    )
    body = F.to_json(F.struct(pair.alias("examples")))
    kind = F.col("doc_id") % 6
    broken = F.when(kind == 0, F.concat(F.lit("Sorry: "), body)).when(kind == 1, F.substring(body, 1, 12)).otherwise(body)
    return docs.select("doc_id", broken.alias("response"))


@query(
    "d11_response_examples",
    """SELECT doc_id, unnest([text, lang]) AS text, unnest(['UNSAFE', 'SAFE']) AS label FROM documents WHERE doc_id % 6 > 1""",
)
def d11(spark, sf):
    return cu.parse_responses(responses(spark, sf), "examples")[0]


@query("d11_rejected_responses", "SELECT count(*) AS rejected FROM documents WHERE doc_id % 6 <= 1")
def d11_rejects(spark, sf):
    return cu.parse_responses(responses(spark, sf), "examples")[1].agg(F.count("*").alias("rejected"))


@query(
    "d11_response_sentences",
    "SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents",
)
def d11_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    body = F.to_json(F.struct(F.split("text", "\n").alias("sentences")))
    return cu.parse_responses(docs.select("doc_id", body.alias("response")), "sentences")[0]


_TWINS = """SELECT doc_id, text, 'UNSAFE' AS label, 'twin_original' AS source, '' AS source_text FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT doc_id, source || ' ' || lang, 'SAFE', 'twin_generated', text FROM documents WHERE doc_id % 4 <> 0"""


@query("d17_twin_pairs", _TWINS)
def d17(spark, sf):
    docs = table(spark, sf, "documents")
    twin = F.when(F.col("doc_id") % 4 != 0, F.concat_ws(" ", "source", "lang"))
    # a response without a twin has no usable rows
    body = F.to_json(F.struct(twin.alias("twin_text")))
    asked = docs.select("doc_id", "text", body.alias("response"))
    twins, _ = cu.parse_responses(asked, "twin_text")
    return cu.twin_pairs(twins)


# --- labels and provenance --------------------------------------------------


@query(
    "d13_tagged_examples",
    """SELECT doc_id, text, 'SAFE' AS label, 'hard_negative' AS source, '' AS source_text FROM documents WHERE lang = 'de'
    UNION ALL SELECT doc_id, text, 'UNSAFE', 'translated', text FROM documents WHERE lang <> 'de'""",
)
def d13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    safe = cu.tag(docs.where("lang = 'de'"), "SAFE", "hard_negative", "")
    translated = cu.tag(docs.where("lang <> 'de'"), "UNSAFE", "translated", F.col("text"))
    return cu.combine(safe, translated).drop("lang")


@query(
    "d21_combined_run",
    """SELECT doc_id, text, 'SAFE' AS label, 'synthetic' AS source, NULL::VARCHAR AS source_text FROM documents WHERE lang = 'de'
    UNION ALL SELECT doc_id, text, 'UNSAFE', 'translated', lang FROM documents WHERE lang <> 'de'
    UNION ALL SELECT doc_id, text, 'UNSAFE', 'twin_original', '' FROM documents WHERE lang <> 'de'
    UNION ALL SELECT doc_id, 'nicht ' || text, 'SAFE', 'twin_generated', text FROM documents WHERE lang <> 'de'""",
)
def d21(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    synthetic = cu.tag(docs.where("lang = 'de'").drop("lang"), "SAFE", "synthetic")
    translated = cu.tag(docs.where("lang <> 'de'"), "UNSAFE", "translated", F.col("lang")).drop("lang")
    earlier = cu.combine(synthetic, translated)
    unsafe = earlier.where("label = 'UNSAFE'").select("doc_id", "text")
    twins = cu.twin_pairs(unsafe.withColumn("twin_text", F.concat(F.lit("nicht "), F.col("text"))))
    return cu.combine(earlier, twins)


@query("d22_answers_as_texts", "SELECT text AS text, 'SAFE_APP_CONTEXT' AS label FROM conversations WHERE role = 'assistant'")
def d22(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    return cu.answers_as_examples(turns.select(F.col("text").alias("answer")))


_LITERALS = [(t, "UNSAFE") for t in HARD_UNSAFE_TEXTS] + REPAIR_EXAMPLES


@query(
    "d23_with_literal_rows",
    f"WITH {SAFETY} SELECT text, label FROM safety UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({co.sql_list(r)})" for r in _LITERALS)
    + ") v(text, label)",
)
def d23(spark, sf):
    return cu.combine(safety(spark, sf).select("text", "label"), cu.literal_examples(spark))


@query(
    "d23_merged_training_set",
    f"""WITH {SAFETY}, a AS (SELECT text FROM conversations WHERE role = 'assistant' ORDER BY md5('42:' || (conv_id * 1000 + turn)) LIMIT 75)
    SELECT text, (label = 'UNSAFE')::INTEGER AS label FROM safety UNION ALL SELECT text, 0 FROM a UNION ALL SELECT text, (label = 'UNSAFE')::INTEGER FROM (VALUES """
    + ", ".join(f"({co.sql_list(r)})" for r in _LITERALS)
    + ") v(text, label)",
)
def d23_merged(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    answers = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("answer"))
    return cu.merge_training_set(safety(spark, sf), answers)


_ODD = """odd AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'UNSAFE' WHEN doc_id % 4 = 1 THEN 'SAFE' WHEN doc_id % 4 = 2 THEN 'SAFE_CONTEXT' END AS label FROM documents)"""


def odd_labels(spark, sf):
    kind = F.col("doc_id") % 4
    label = F.when(kind == 0, "UNSAFE").when(kind == 1, "SAFE").when(kind == 2, "SAFE_CONTEXT")
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query("d24_binary_labels", f"WITH {_ODD} SELECT doc_id, CASE WHEN label = 'UNSAFE' THEN 1 ELSE 0 END AS y FROM odd")
def d24(spark, sf):
    return odd_labels(spark, sf).select("doc_id", cu.to_binary("label").alias("y"))


@query("d25_mapped_labels", f"WITH {_ODD} SELECT doc_id, CASE label WHEN 'UNSAFE' THEN 1 WHEN 'SAFE' THEN 0 END AS y FROM odd")
def d25(spark, sf):
    return odd_labels(spark, sf).select("doc_id", cu.map_label("label", SAFETY_IDS).alias("y"))


@query(
    "d27_class_balance",
    f"""WITH {SAFETY} SELECT count(*) FILTER (label = 'SAFE') AS safe_count, count(*) FILTER (label = 'UNSAFE') AS unsafe_count,
      count(*) AS total, round(count(*) FILTER (label = 'SAFE')::DOUBLE / nullif(count(*) FILTER (label = 'UNSAFE'), 0), 6) AS ratio FROM safety""",
)
def d27(spark, sf):
    return cu.class_balance(safety(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query("d27_label_counts", f"WITH {_ODD} SELECT label, count(*) AS n FROM odd WHERE label IS NOT NULL GROUP BY 1")
def d27_counts(spark, sf):
    return cu.value_counts(odd_labels(spark, sf), "label")


@query(
    "d29_stripped_quotes",
    r"""WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN '"''' || text || '''' ELSE text END AS t FROM documents)
    SELECT doc_id, trim(trim(t, '"'), '''') AS text FROM q""",
)
def d29(spark, sf):
    kind = F.col("doc_id") % 3
    quoted = (
        F.when(kind == 0, F.concat(F.lit('"'), "text", F.lit('"')))
        .when(kind == 1, F.concat(F.lit("\"'"), "text", F.lit("'")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", strip_quotes(quoted).alias("text"))


@query(
    "d30_previews",
    """SELECT doc_id, CASE WHEN length(text) > 60 THEN text[1:60] || '...' ELSE text END AS short,
       CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS long FROM documents""",
)
def d30(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview("text", 60).alias("short"), preview("text", 200).alias("long"))


@query(
    "d31_resolved_labels",
    """SELECT '1' AS positive, (SELECT toxic::VARCHAR FROM labels WHERE toxic <> 1 ORDER BY doc_id LIMIT 1) AS negative FROM labels HAVING count(*) FILTER (toxic = 1) > 0""",
)
def d31(spark, sf):
    return cu.resolve_labels(table(spark, sf, "labels"), "1", "toxic")


@query("d32_category_counts", "SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def d32(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("category"))
    return cu.category_counts(docs)


# --- exercises --------------------------------------------------------------


def exercise_trees(spark, sf):
    """One tree per document: its lines are the blocks, every third a question.

    Some nodes have another shape and must be skipped.
    """
    docs = spread(table(spark, sf, "documents"), "doc_id")
    lines = F.split("text", "\n")
    block = F.transform(
        lines,
        lambda line, i: F.when(
            i % 3 == 2,
            F.struct(
                F.lit(None).cast("string").alias("Text"),
                line.alias("Question"),
                F.when(i % 2 == 0, "free_text").otherwise("choice").alias("AnswerOptions"),
            ),
        ).otherwise(
            F.struct(
                line.alias("Text"), F.lit(None).cast("string").alias("Question"), F.lit(None).cast("string").alias("AnswerOptions")
            )
        ),
    )
    name = F.concat(F.lit("ex"), F.col("doc_id").cast("string"))
    tree = F.concat(
        F.lit('{"meta": 3, "'), F.col("lang"), F.lit('": {"note": "x", "'), F.col("source"), F.lit('": {"'), name,
        F.lit('": '), F.to_json(block), F.lit(', "other": {"a": "b"}}}}'),
    )
    return docs.select(tree.alias("tree"))


_BLOCKS = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
blocks AS (
  SELECT lang AS category, source AS subcategory, 'ex' || doc_id AS exercise, pos::INTEGER AS pos,
         CASE WHEN pos % 3 <> 2 THEN line END AS text, CASE WHEN pos % 3 = 2 THEN line END AS question,
         CASE WHEN pos % 3 = 2 THEN CASE WHEN pos % 2 = 0 THEN 'free_text' ELSE 'choice' END END AS answer_options
  FROM lines)"""
_CONTEXTS = f"""{_BLOCKS}, ctx AS (
  SELECT *, last_value(CASE WHEN {co.sql_replace('text', co.WS, '')} <> '' THEN text END IGNORE NULLS)
    OVER (PARTITION BY category, subcategory, exercise ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM blocks),
asked AS (
  SELECT category, subcategory, exercise, pos, regexp_replace(c, '^{co.WS}+|{co.WS}+$', '', 'g') AS text, question FROM ctx
  WHERE text IS NULL AND question <> '' AND answer_options = 'free_text' AND c IS NOT NULL)"""


@query("d18_exercise_blocks", f"WITH {_BLOCKS} SELECT * FROM blocks")
def d18(spark, sf):
    return cu.flatten_exercises(exercise_trees(spark, sf))


@query("s7_exercise_files", f"WITH {_BLOCKS} SELECT exercise, count(*) AS blocks FROM blocks GROUP BY 1")
def s7(spark, sf):
    # the trees as written files, read back
    path = new_dir(spark, "exercises")
    trees = exercise_trees(spark, sf)
    trees.write.text(path)
    back = st.read_exercises(spark, path, per_line=True)
    return cu.flatten_exercises(back).groupBy("exercise").agg(F.count("*").alias("blocks"))


@query("d19_question_contexts", f"WITH {_CONTEXTS} SELECT * FROM asked")
def d19(spark, sf):
    return cu.exercise_contexts(cu.exercise_lists(exercise_trees(spark, sf)))


@query("d19_block_contexts", f"WITH {_CONTEXTS} SELECT * FROM asked")
def d19_blocks(spark, sf):
    return cu.question_contexts(cu.flatten_exercises(exercise_trees(spark, sf)))


@query(
    "d19_conversation_contexts",
    """WITH f AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context FROM conversations)
    SELECT conv_id, turn, context, text AS question FROM f WHERE role = 'user' AND context IS NOT NULL""",
)
def d19_turns(spark, sf):
    turns = table(spark, sf, "conversations")
    said = F.when(F.col("role") == "assistant", F.col("text"))
    question = F.when(F.col("role") == "user", F.col("text"))
    blocks = turns.select("conv_id", "turn", said.alias("text"), question.alias("question"), F.lit("free_text").alias("answer_options"))
    found = cu.question_contexts(blocks, ["conv_id"], "turn")
    return found.select("conv_id", "turn", F.col("text").alias("context"), "question")


@query(
    "d20_answer_rows",
    f"""WITH {_CONTEXTS} SELECT exercise, text, question, regexp_replace(question || ' ja', '^{co.WS}+', '') AS answer,
        ([{co.sql_list(OUTPUT_LENGTHS)}])[pos % 3 + 1] AS length_instruction FROM asked""",
)
def d20(spark, sf):
    asked = cu.exercise_contexts(cu.exercise_lists(exercise_trees(spark, sf)))
    length = F.get(string_array(OUTPUT_LENGTHS), F.col("pos") % 3)
    answered = asked.withColumn("answer", F.concat("question", F.lit(" ja  "))).withColumn("length_instruction", length)
    return cu.answer_rows(answered)
