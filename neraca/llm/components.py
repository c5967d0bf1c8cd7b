"""Connected components of a link table by alternating large and small stars.

Every round rewrites the links so that a node points to a smaller one; the table never holds
more than the links it started with.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neraca.session import cut_lineage, discard


def _settled(edges: DataFrame) -> bool:
    """Whether no node points to two others, or both points and is pointed at: then all links are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node except the smallest of each component, its name.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    edges = cut_lineage(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        edges = fresh
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
