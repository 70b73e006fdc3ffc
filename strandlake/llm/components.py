"""Connected components of a graph held as an edge table.

Alternating large-star and small-star steps turn every component into a star round
its smallest node. Each step is joins and partial aggregates on the node; edges of
a round are written to the shared folder, so lineage stays short and lost executors
cost one round. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """Neighbours of each u, hung on the least of them."""
    least = materialize(least, "least")
    # Both sides are plain scans dealt by u, so a hub's rows can be split at run time.
    joined = pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    own = least.where(F.col("u") > F.col("m")).select("u", F.col("m").alias("v"))
    out = materialize(joined.unionByName(own).distinct(), name)
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``edges`` of two long columns to (node, component): the smallest node that can be reached.

    Only nodes with an edge to another node appear. Repeated edges and loops are fine.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where(F.col("v") > F.col("u")), least, "large")
        small = _star(large, large.groupBy("u").agg(F.min("v").alias("m")), "small")
        discard(large)
        new = _digest(small)
        discard(now)
        now, before, seen = small, seen, new
        if new == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", F.col("v").alias("component")).distinct().toDF("node", "component"))
