"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.storage import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars: every a has one b, which is no a itself. Then b is the component of a."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "a")
    above = F.col("node") == F.col("a")
    counted = ends.groupBy("node").agg(F.count_if(above).alias("above"), F.count_if(~above).alias("below"))
    return counted.filter((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("below") > 0))).isEmpty()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # large star: every larger neighbour of a goes to the least node around a
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    # small star: a and its smaller neighbours go to the least of them
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another.

    Rows with a null end and self-loops carry no link and are left out; repeated and reversed edges
    count once; no edges give no rows. Each step sends a minimum per node, combined before the
    shuffle, and at most one row per edge. Rounds grow with the logarithm of the longest chain; the
    edges are written to the shared folder after each, so lost executors cost one round at most. Stars
    need no round: earlier components given as edges cost little beside new edges.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = materialize(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a > b").distinct(), "edges")
    for turn in range(max_rounds):
        if _settled(now):
            break
        now = materialize(_stars(now), f"edges{turn}")
    else:
        if not _settled(now):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
