"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger (or, small: smaller) neighbours to the least node around it."""
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("u", "m"))
    least = materialize(least, "star")
    total = max(1, least.agg(F.sum("degree")).first()[0] or 1)
    near = join_dealt(around, least, "u", "degree", total)
    out = near.filter(F.col("v") <= F.col("u") if small else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that it reaches.

    Hot nodes are dealt over parts. Loops and repeated edges do no harm; nulls are ignored.
    """
    now = materialize(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u != v").distinct(), "edges")
    said = _digest(now)
    while said[0]:
        now = materialize(_star(materialize(_star(now, small=False), "large"), small=True), "small")
        new = _digest(now)
        if new == said:
            break
        said = new
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(leaf.select(F.col("component").alias("node"), "component").distinct())
