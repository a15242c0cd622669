"""The registered queries of the package, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import (
    bpe, collocations, embedding_dedup, langid, lexical_search, packing, quality_rules, simhash, token_counts,
    top_k, toxicity, url_filter, warc,
)
from laurel.llm.batches import use_small_batches
from laurel.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(modulus: int, rest: int) -> Column:
    """Whether a document is held out; null ids are not."""
    text = F.col("doc_id").cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % modulus == rest, F.lit(False))


URL_RULES = [
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, folder, "pages"), URL_RULES)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~_fold(3, 1)))
    judged = docs.select("doc_id", _fold(3, 1).alias("held_out"), model.judge_column("text").alias("j"))
    place = lambda span: F.concat_ws("-", span["start"], span["end"])
    return judged.select(
        "doc_id", "held_out", F.col("j.score").alias("score"), (F.col("j.score") >= 0.7).cast("int").alias("predicted"),
        F.size("j.spans").alias("n_offending"),
        F.array_join(F.transform("j.spans", place), ";").alias("offending"),  # characters of the text
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    members = simhash.simhash_components(_table(spark, folder, "documents"))
    return members.select(
        F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = docs.select("doc_id", bpe.round_trip_column("text").alias("t"))
    return found.select(
        "doc_id", (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("t.ids", 256).alias("ids_sha256"), F.sha2("t.decoded", 256).alias("decoded_sha256"),
    )


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_dedup.embedding_components(_table(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.with_suffix_sums(token_counts.length_histogram(_table(spark, folder, "documents")))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.where(~_fold(4, 2)))
    found = docs.select("doc_id", _fold(4, 2).alias("held_out"), model.predict_column("text").alias("found"))
    return found.select(
        "doc_id", "held_out", F.col("found.language").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    made = warc.derivatives(warc.responses(_table(spark, folder, "pages")))
    return made.withColumnRenamed("id", "page_id")


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k_search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_top_k": op10_top_k,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

__all__ = ["QUERIES", "SQL"]
