"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding. Every stage works on what the one before kept.

Defined results: a null or empty text, and one without a letter, goes in the first stage; ``lang`` is the predicted language from there on; of equal
texts the largest id stays, of near copies the smallest; rows with equal id and text are one after the second stage; a null source is a
source of its own; an empty table gives an empty result; columns that a stage does not use pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import bpe, exact_dedup, language, mixing, near_dedup
from kgspark.session import ensure_checkpoint_dir


BATCH_ROWS = "1000"  # of whole texts that Spark and a Python worker pass each other at a time


def _short_batches(spark: SparkSession) -> None:
    """Arrow batches for rows with long texts, unless the session asks for shorter ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > int(BATCH_ROWS):
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` as predicted; those without any letter go."""
    _short_batches(spark)
    return language.with_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles at similarity 0.8 or more."""
    _short_batches(spark)
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: texts whole, cut to the words taken, or twice."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` and the digests of ids and decoded text."""
    _short_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.build_lexicon(docs), digest=True)
    return coded.select("row.*", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("encoding", encoding)]
ORACLE_SQL = None  # learned probabilities, hashed signatures and the library's merges have no SQL form; tests/llm/test_pipeline.py has a brute-force twin


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
