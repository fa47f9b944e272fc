"""One query per operator, over whole tables, and SQL where it can state the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textveil.llm.frames import importable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mix_sources")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.mixing import mix_sources

    rows = mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_pack_by_cost")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_site_quality")
def site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "doc_log_odds", "host_rate", "path_rate", "quality_score", "keep")


@query("op9_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.jaccard import similar_documents

    found = similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op2_class_kneser_ney")
def class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.toxicity import score_toxicity

    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), labels, train=part != 1)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", "predicted", "toxic_ll", "ordinary_ll")


@query("op4_seekable_warc")
def seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


@query(
    "op5_multi_index_hamming",
    """
    WITH codes AS (
      SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
    ), pairs AS (
      SELECT q.id AS query_id, c.id,
        CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM codes q, codes c WHERE q.id % 20 = 0
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs
    )
    SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
    """,
)
def multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.hamming import nearest_codes, sign_code

    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return nearest_codes(codes, codes.where("id % 20 = 0"))


@query("op6_chat_tokens")
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.chat import format_chats, read_chats

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return read_chats(format_chats(rows.unionByName(more), path), path)


@query("op8_invertible_sketch")
def invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.invertible import fingerprint_versions

    return fingerprint_versions(table(spark, sf_dir, "documents"))


@query("op3_katz_backoff")
def katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.katz import score_texts

    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return score_texts(table(spark, sf_dir, "documents"), part != 0)


@query(
    "op13_merkle_manifest",
    """
    WITH RECURSIVE docs AS (
      SELECT doc_id, source, text, lang, n_chars,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
        list_reduce(
          list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda crc, c: list_reduce(list_concat([xor(crc, c)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)
        ) AS crc
      FROM documents
    ), fields AS (
      SELECT doc_id, source, coalesce(xor(crc, CAST(4294967295 AS BIGINT)) % 5 = 0, FALSE) AS tampered,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(lowered) || ':' || lowered, '-') AS lowered
      FROM docs
    ), leaves AS (
      SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN lowered ELSE body END) AS changed FROM fields
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
      FROM leaves
    ), nodes AS (
      SELECT 0 AS level, tree, idx, count(*) OVER (PARTITION BY tree) AS size, leaf AS digest FROM placed
      UNION ALL
      SELECT level + 1, tree, idx // 16, (any_value(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
      FROM nodes WHERE size > 1 GROUP BY level, tree, idx // 16
    ), tops AS (
      SELECT 0 AS level, tree AS idx, count(*) OVER () AS size, digest FROM nodes WHERE size = 1
      UNION ALL
      SELECT level + 1, idx // 16, (any_value(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
      FROM tops WHERE size > 1 GROUP BY level, idx // 16
    ), around AS (
      SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
        coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
      FROM nodes a JOIN nodes b ON a.level = b.level AND a.tree = b.tree AND a.idx // 16 = b.idx // 16
      WHERE a.size > 1 GROUP BY ALL
    ), around_tops AS (
      SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
        coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
      FROM tops a JOIN tops b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY ALL
    ), climbed AS (
      SELECT tree, idx AS leaf_idx, 0 AS level, idx, changed AS digest, '' AS proof FROM placed
      UNION ALL
      SELECT c.tree, c.leaf_idx, c.level + 1, c.idx // 16, sha256(a.before || c.digest || a.after), c.proof || a.before || a.after
      FROM climbed c JOIN around a ON c.level = a.level AND c.tree = a.tree AND c.idx = a.idx
    ), lower_half AS (
      SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY level DESC) = 1
    ), climbed_on AS (
      SELECT tree, leaf_idx, 0 AS level, tree AS idx, digest, proof FROM lower_half
      UNION ALL
      SELECT c.tree, c.leaf_idx, c.level + 1, c.idx // 16, sha256(a.before || c.digest || a.after), c.proof || a.before || a.after
      FROM climbed_on c JOIN around_tops a ON c.level = a.level AND c.idx = a.idx
    ), done AS (
      SELECT * FROM climbed_on QUALIFY row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY level DESC) = 1
    )
    SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256,
      d.digest AS folded_root, d.digest = r.digest AS verified
    FROM placed p JOIN done d ON p.tree = d.tree AND p.idx = d.leaf_idx
    JOIN nodes s ON s.tree = p.tree AND s.size = 1 JOIN tops r ON r.size = 1
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.merkle import as_text, folded, leaf_digest, manifest, proof

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    head = ["doc_id", "source", "lang", "n_chars"]
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", leaf_digest([*head, "text"]).alias("leaf"), leaf_digest([*head, changed]).alias("found"))
    made = manifest(rows, "source", "doc_id")
    root = F.lit(made.root)
    found = made.leaves.withColumn("folded_root", folded(as_text(F.col("row.found")), F.col("path")))
    return found.select(
        F.col("row.doc_id"), as_text(F.col("digest")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


@query(
    "op12_phrase_graph",
    r"""
    WITH texts AS (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS t,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), pieces AS (
      SELECT lang, t, unnest(list_zip(range(1, len(p) + 1), p)) AS piece FROM (SELECT lang, t, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM texts)
    ), worded AS (
      SELECT lang, t, piece[1] AS nr, unnest(list_zip(range(1, len(w) + 1), w)) AS word
      FROM (SELECT lang, t, piece, regexp_extract_all(piece[2], '[^\x20\x09]+') AS w FROM pieces)
    ), runs AS (
      SELECT lang, word[2] AS x, lead(word[2], 1) OVER piece AS y, lead(word[2], 2) OVER piece AS z
      FROM worded WINDOW piece AS (PARTITION BY lang, t, nr ORDER BY word[1])
    ), f AS (
      SELECT lang, 1 AS k, x AS phrase, [x] AS words, CAST(count(*) AS HUGEINT) AS n FROM runs GROUP BY lang, x
      UNION ALL
      SELECT lang, 2, x || ' ' || y, [x, y], count(*) FROM runs WHERE y IS NOT NULL GROUP BY lang, x, y
      UNION ALL
      SELECT lang, 3, x || ' ' || y || ' ' || z, [x, y, z], count(*) FROM runs WHERE z IS NOT NULL GROUP BY lang, x, y, z
    ), candidates AS (
      SELECT * FROM f WHERE k >= 2 AND n >= 10
    ), cuts AS (
      SELECT c.lang, c.k, c.phrase, c.n, j, array_to_string(words[1:j], ' ') AS first_part, array_to_string(words[j + 1:], ' ') AS rest
      FROM candidates c, (VALUES (1), (2)) AS js(j) WHERE j < k
    ), scored AS (
      SELECT c.lang, c.k, c.phrase, c.n AS a, x.n AS l, y.n AS r, CAST((1000000 * c.n * c.n) // (x.n * y.n) AS BIGINT) AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part AND x.k = c.j
      JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.k = c.k - c.j
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000 * c.n * c.n) // (x.n * y.n), c.j) = 1
    ), dropped AS (
      SELECT DISTINCT s.lang, s.phrase FROM candidates l, (VALUES (1), (2)) AS js(j)
      JOIN scored s ON s.k = 2 AND s.lang = l.lang AND s.phrase = array_to_string(l.words[j:j + 1], ' ') WHERE l.k = 3 AND 100 * l.n >= 50 * s.a
    ), ranked AS (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
      FROM scored s WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = s.lang AND d.phrase = s.phrase)
    )
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
      (SELECT CAST(sum(n) AS BIGINT) FROM f WHERE f.k = 1 AND f.lang = ranked.lang) AS n, score
    FROM ranked WHERE rank <= 2000
    """,
)
def phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query(
    "op11_fixed_block_anchors",
    r"""
    WITH texts AS (
      SELECT row_number() OVER () AS t, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), words AS (
      SELECT t, unnest(list_zip(range(1, len(w) + 1), w)) AS x FROM texts
    ), s1 AS (
      SELECT t, x[1] AS i, x[2] AS word FROM words
    ), s2 AS (
      SELECT *, word || ' ' || lead(word, 1) OVER d AS two FROM s1 WINDOW d AS (PARTITION BY t ORDER BY i)
    ), s4 AS (
      SELECT *, two || ' ' || lead(two, 2) OVER d AS four FROM s2 WINDOW d AS (PARTITION BY t ORDER BY i)
    ), s8 AS (
      SELECT t, i, word, two, four || ' ' || lead(four, 4) OVER d AS eight FROM s4 WINDOW d AS (PARTITION BY t ORDER BY i)
    ), s16 AS (
      SELECT t, i, word, two, eight || ' ' || lead(eight, 8) OVER d AS sixteen FROM s8 WINDOW d AS (PARTITION BY t ORDER BY i)
    ), s35 AS (
      SELECT t, i, word, sixteen || ' ' || lead(sixteen, 16) OVER d || ' ' || lead(two, 32) OVER d || ' ' || lead(word, 34) OVER d AS run
      FROM s16 WINDOW d AS (PARTITION BY t ORDER BY i)
    ), judged AS (
      SELECT t, i, word, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS repeated FROM s35
    ), covered AS (
      SELECT t, i, word, bool_or(repeated) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM judged
    ), kept AS (
      SELECT t, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text
      FROM covered GROUP BY t
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (t)
    """,
)
def fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.anchors import without_repeats

    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
