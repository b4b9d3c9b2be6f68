"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest one around it: the larger ones (``both``: over all neighbours) or the smaller ones."""
    if both:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    out = around.join(least, "a")
    if both:
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that can be reached) of every node with an edge ``a, b``; loops are ignored.

    Each round is written to the shared folder, so neither lineage nor the driver grows; the driver sees two numbers a round.
    """
    now = stage(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct().select("a", "b"), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    was = mark(now)
    while was[0]:
        now = stage(_star(_star(now, True), False), "edges")
        if (is_ := mark(now)) == was:
            break
        was = is_
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
