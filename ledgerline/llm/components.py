"""Connected components of an edge table, by alternating star contractions.

Each round only keeps the least neighbour of a node, found by an aggregate with partial sums in the
tasks, and joins it back, so a node with very many neighbours is a skewed plain join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the least of the node's neighbours and itself."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).select("col.*")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label``: for each node of an edge, the least node of its component.

    Edges may repeat and point either way; edges from a node to itself and edges with a null end are
    left out. The number of rounds grows with the logarithm of the longest path; each round's edges are
    written to the checkpoint folder.
    """
    now = durable(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    was = state(now)
    while was[0]:
        now = durable(_small_star(_large_star(now)))
        is_now = state(now)
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
