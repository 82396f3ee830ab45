"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmill.session import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges`` has ``u > v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node of its component.

    Minima are taken before the exchange, so a node with very many links is no hot spot; each round is
    written to the shared folder.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    digest = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = edges.agg(*digest).first()
    while True:
        edges = cut_lineage(_stars(edges), "edges")
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
