"""A corpus from raw documents to packed sequences, one operator a stage.

Each stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import textveil.llm.queries as queries
from pyspark.sql import DataFrame, SparkSession, functions as F
from textveil.llm.frames import importable, stored
from textveil.llm.jaccard import without_near_copies
from textveil.llm.mixing import mixed_documents
from textveil.llm.packing import pack_documents
from textveil.llm.quality import score_quality
from textveil.llm.toxicity import score_toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    scored = score_quality(docs, queries.table(spark, sf_dir, "labels"))
    return scored.where("keep").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not found toxic."""
    scored = score_toxicity(docs, queries.table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a row for each time a document is taken."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
