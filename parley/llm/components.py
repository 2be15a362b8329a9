"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_join


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger (small: its not larger) neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = skew_join(both, least, ["a"], "inner")
    out = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = out.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))) if small else out.filter("a > b").unionByName(least.filter("a <> m").select("a", F.col("m").alias("b")))
    return out.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): longs, no nulls, any order, repeats allowed. Returns (node, root) for each node that is not the least of its component.

    Each round ends in a table in the shared folder, so lineage stays short. It is the last when every node has one link and no
    root has any, which takes three counts to see.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        now = materialize(_star(_star(now, small=False), small=True), "links")
        sides = now.select("a", F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("a"), F.lit(1).alias("root")).distinct())
        ends = sides.groupBy("a").agg(F.count_if(F.col("root") == 0).alias("links"), F.max("root").alias("root"))
        if not ends.filter("links > 1 OR (links > 0 AND root = 1)").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
