"""Connected components of a graph given as links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Joins neighbours to the least of a node and its neighbours: the larger neighbours (large star), or the node and its smaller ones (small star)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = ends.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); the component is named by its least node. Each round is
    written out, so a lost executor costs one round; the fixed point ends them. Stars are joined by node; a hub's rows are split by the skew join."""
    now = written(links.where("a <> b").distinct(), "links")
    mark = None
    while True:
        now = written(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
