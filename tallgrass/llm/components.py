"""Connected components of a link table, as a distributed alternation of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import scratch, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger (large-star) or smaller (small-star) neighbours to its least one."""
    if large:
        sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = sym.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b always
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(a, b)``; the component is its least node.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round. The rounds end when the links no longer change (compared by count and an order-free sum of
    hashes, two numbers a round).
    """
    spark = edges.sparkSession
    with scratch(spark) as outer:
        links = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
        seal = None
        while True:
            links = staged(_star(_star(links, True), False), "links")
            now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(now) == seal:
                return outer.out(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "components")
            seal = tuple(now)
