"""A corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every result as
Parquet into the folder all executors share and hands the stored rows on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import langid, packing, simhash, toxicity
from laurel.llm.batches import use_small_batches
from laurel.sources.storage import shared_folder

TOXIC_FROM = 0.7
MIN_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC_FROM."""
    use_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return docs.where(model.score_column(F.col("text")) < TOXIC_FROM)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is told with some confidence."""
    use_small_batches(spark)
    found = langid.fit(docs).predict_column(F.col("text"))
    return docs.where((found["language"] != langid.UNKNOWN) & (found["score"] >= MIN_LANGUAGE_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints differ in at most four bits."""
    use_small_batches(spark)
    return simhash.near_dedup(docs, words=4, max_bits=4)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    use_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

# Learned models, a tokenizer and XXH64 cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
