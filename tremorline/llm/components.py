"""Connected components of a distributed edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.session import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Directed edges (v, u) with m, the least of v and all its u."""
    least = edges.groupBy("v").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    # Joined under another key than that of the groups, so that AQE can split the edges of a hot vertex.
    key = F.concat(F.col("v"), F.lit("."))
    return edges.withColumn("_key", key).join(least.select(key.alias("_key"), "m"), "_key").drop("_key")


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(v, u)`` (strings), root being the least vertex of its component.

    Alternates large-star and small-star steps, each a count and a join over all edges, until the edges are stars around their
    roots. Each round is written to the shared folder. Self-loops are ignored; no edges, no rows.
    """
    edges = materialize(edges.filter("v <> u").select("v", "u").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _with_least(both).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        down = large.filter("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()
        small = _with_least(down)
        stars = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            small.select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        edges = materialize(stars, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select("v", F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
