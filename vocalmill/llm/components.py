"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial minimum per node and a join back; the edges of each round are written to the shared folder,
so a round never depends on the memory of an executor.  Nothing is collected but one checksum row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b stand for links.  Large: neighbours above a node go to its least neighbour; small: those below."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = down.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _minima(both).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = _minima(down)
        joined = down.join(least, "u")
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.  Null ends and self-links count as none."""
    edges = C.materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND a != b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        wide = C.materialize(_star(edges, True), "edges")
        C.discard(edges)
        edges = C.materialize(_star(wide, False), "edges")
        C.discard(wide)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
