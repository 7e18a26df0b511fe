"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.session import stash


def _small(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours to the smallest of them. Edges are (u, v), u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(F.array(F.struct(F.col("v").alias("u"), "m")))).alias("s"))
    return moved.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct()


def _large(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around it."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Both kinds of star step aggregate before they shuffle and keep every edge's ends
    connected, so a hub costs one row a task; joins on a hub are left to AQE's splitting.
    Self-loops count as an edge of their node; rows with a null end are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e, "edges")
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    mark = None
    for _ in range(max_rounds):
        e = stash(_small(_large(e)), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().join(stars, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionAll(roots).unionAll(alone).distinct()
