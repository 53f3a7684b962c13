"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes the table that the one before has written and works on all of it.
All but the last return the columns of ``documents``.  Whoever writes what a stage
returns, its Python work is done by then, in batches of ``BATCH_ROWS``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, exact_dedup, jaccard, langid, mixing
from assayer.llm.shared import batches, packed, repeated, stored

#: Near duplicates share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Whole documents that a task hands to Python at a time; the JVM and the worker, which live on for the next stage, hold a copy each.
BATCH_ROWS = 1_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, of which no language can be told, go."""
    rows = packed(docs)
    with batches(spark, BATCH_ROWS):
        model = langid.fit(langid.learning_rows(docs))
        judged = stored(langid.accepted(rows.select("row", "doc.text"), model), "known")
    return repeated(rows, judged.select("row", F.col("known").cast("int").alias("copies")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    rows = packed(docs)
    with batches(spark, BATCH_ROWS):
        found = exact_dedup.dedup(rows.select("row", "doc.doc_id", "doc.text"))
    return repeated(rows, found.select("row", F.col("kept").cast("int").alias("copies")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets one stays, that with the smallest id."""
    rows = packed(docs)
    with batches(spark, BATCH_ROWS):
        found = jaccard.components(rows.select("row", "doc.doc_id", "doc.text"), NEAR_WORDS, NEAR_PERCENT)
    grouped = stored(found.select("row", "doc_id", "group"), "near", free=True)
    stays = stored(grouped.where("group IS NOT NULL").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("size"))
        .where("size > 1"), "stays", free=True)
    goes = F.coalesce(F.col("row") != F.col("first.row"), F.lit(False))
    return repeated(rows, grouped.join(stays, "group", "left").select("row", F.when(goes, 0).otherwise(1).alias("copies")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return stored(bpe.digests(docs, ranks, public_tokenizers.PATTERN), "tokens", batch=BATCH_ROWS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact_copies), ("jaccard_join", near_copies),
    ("mix_sources", mixed), ("bpe", encoded),
]

#: Language identification, the components of the join and the tokenizer have no SQL form;
#: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
