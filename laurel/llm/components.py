"""Connected components of a link table, by contraction.

In each round every vertex points to the smallest vertex among itself and its neighbours,
links move to those representatives, and loops and repeats disappear. "Smallest" goes by a
hash of the vertex, so chains of ascending ids shrink as fast as others: each round removes
a fixed share of the vertices. The pointers of all rounds are then followed backwards.
Only a row count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.sources.storage import cut_lineage as checkpointed


def _pointers(links: DataFrame) -> DataFrame:
    """The smallest neighbour, or the vertex itself, of every vertex."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    least = both.groupBy("u").agg(F.min(order("v")).alias("least"))
    return least.select("u", F.least("least", order("u"))["x"].alias("to"))


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of `links` (u, v); vertices of a component share a root.

    Loops and repeated links are allowed. An empty table gives an empty result.
    """
    edges = checkpointed(links.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    rounds = []
    while not edges.isEmpty():
        to = checkpointed(_pointers(edges))
        rounds.append(to)
        edges = checkpointed(
            edges.join(to.withColumnRenamed("to", "a"), "u")
            .join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
    if not rounds:
        return edges.select(F.col("u").alias("vertex"), F.col("u").alias("root"))
    known = rounds.pop().select(F.col("u").alias("vertex"), F.col("to").alias("root"))
    while rounds:
        later = known.withColumnRenamed("vertex", "to")
        known = rounds.pop().join(later, "to", "left").select(
            F.col("u").alias("vertex"), F.coalesce("root", "to").alias("root")
        )
    return known


