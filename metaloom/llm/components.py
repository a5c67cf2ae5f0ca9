"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and one join; a written table per step cuts the lineage.
The number of steps grows with the logarithm of the longest path. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom import staging


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour v > u of u (large), or every neighbour v <= u and u itself (small), is linked with the least of them."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (any order, repeated edges and loops allowed) -> ``id``, ``component``: the least id reachable.

    Ids without an edge to another id don't appear. No edges give no rows.
    """
    spark = edges.sparkSession
    now = staging.stage(edges.where("a <> b").select("a", "b").distinct(), staging.new_stage(spark, "edges"))
    before = None
    while True:
        small = _star(_star(now, large=True), large=False)
        now = staging.stage(small, staging.new_stage(spark, "star"))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        before = state
