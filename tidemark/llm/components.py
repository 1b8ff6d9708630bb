"""Connected components of a graph given as edges, by large-star and small-star rounds.

Each round is two aggregations and joins over edges; nothing is collected but
two numbers that tell whether the round changed anything.  A node with very
many neighbours appears as a join key only, where Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), u > v. Links neighbours of u to the least node in reach."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that isn't the least of its component; component is the least node.

    Nodes missing here are their own component.  Edges may repeat, run either way or join a node to itself; edges
    with a null end are no edges.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        after = written(_star(_star(now, large=True), large=False), "edges")
        drop_written(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
