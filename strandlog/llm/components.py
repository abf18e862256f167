"""Connected components of a link table, by alternating large and small stars.

Each step replaces links so that nodes point to ever smaller neighbours; after a number of steps that
grows with the logarithm of the graph every node points to the least node of its component.  The large star is an
aggregate (least neighbour) and a join, so a node with very many links is pre-aggregated and its join can be split.  The
small star sees a node's smaller neighbours only; it is a window over them and gives one link for each.  So a step
has three shuffles, and links never become more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import Scratch


def _step(links: DataFrame) -> DataFrame:
    """links (u, v) with u > v; the same link may stand in the result more than once."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # dealt by node: neither the distinct rows nor the window shuffles again
    small = large.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(a, b) links of bigint nodes -> (node, component) for every node that isn't the least of its component."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.put(now, f"{name}_0")
    mark, step = None, 0
    while True:
        step += 1
        now = scratch.put(_step(now), f"{name}_{step}")
        if step > 1:
            scratch.drop(f"{name}_{step - 1}")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = found
