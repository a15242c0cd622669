"""Token statistics of a corpus from its exact length histogram.

Documents are counted by encoded length, which Spark combines before it shuffles. All
answers come from the histogram by suffix sums: how many documents and tokens reach a
length, how many tokens remain if texts are cut at a context limit, and quantiles.

Suffix sums have two levels, within blocks of lengths and over the blocks, so no step needs
all lengths in one task. Defined results: null and empty texts have length 0; an empty
table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.llm import bpe
from laurel.llm.components import checkpointed

BLOCK = 1024  # lengths in a block of the suffix sums


def length_histogram(docs: DataFrame, text_col: str = "text", path: str = bpe.RANKS) -> DataFrame:
    """(length, documents) over all rows."""
    lengths = docs.select(bpe.count_column(F.col(text_col), path).alias("length"))
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("documents"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add totals over all lengths from this one on, and the corpus totals.

    docs_at_least, tokens_at_least: documents of this length or more and their tokens;
    truncated_tokens: tokens of the corpus if every document is cut at this length;
    total_docs, total_tokens; quantile: share of documents of at most this length.
    """
    counted = checkpointed(histogram).withColumns({  # read twice below, encoded once
        "block": F.floor(F.col("length") / BLOCK),
        "tokens": F.col("length") * F.col("documents"),
    })
    blocks = counted.groupBy("block").agg(
        F.sum("documents").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # Blocks are few: the longest document over BLOCK.
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    above = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("total_docs"),
        F.sum("block_tokens").over(every).alias("total_tokens"),
    )
    within = W.partitionBy("block").orderBy(F.desc("length"))
    at_least = lambda c: F.sum(c).over(within)
    summed = counted.join(above, "block").select(
        "length", "documents",
        (at_least("documents") + F.col("docs_above")).alias("docs_at_least"),
        (at_least("tokens") + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs", "total_tokens",
    )
    longer = F.col("docs_at_least") - F.col("documents")
    tokens_longer = F.col("tokens_at_least") - F.col("length") * F.col("documents")
    return summed.select(
        "length", "documents", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - tokens_longer + longer * F.col("length")).alias("truncated_tokens"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
        "total_docs", "total_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens of the corpus if every document is cut at any `limit` (one row)."""
    longer = F.col("length") > limit
    kept = [F.coalesce(F.max(c), F.lit(0)) for c in (
        "total_tokens", F.when(longer, F.col("tokens_at_least")), F.when(longer, F.col("docs_at_least")))]
    return sums.agg((kept[0] - kept[1] + kept[2] * limit).alias("tokens")).select(
        F.lit(limit).alias("context"), "tokens")


def quantile(sums: DataFrame, share: float) -> Column:
    """Smallest length with at least `share` of all documents at or below it, as an aggregate."""
    return F.min(F.when(F.col("quantile") >= share, F.col("length")))
