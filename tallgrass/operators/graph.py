"""Graph queries over node and edge tables: lookup, callers and callees, impact, resolution (GRF, JN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.plans.lineage import cut


def symbols_like(nodes: DataFrame, pattern: str, limit: int = 30) -> DataFrame:
    """FLT-4: substring match in name or qualified name, case-insensitive; ``%`` and ``_`` of the pattern stay wildcards."""
    like = f"%{pattern}%"
    return nodes.where(F.col("name").ilike(like) | F.col("qn").ilike(like)).orderBy("name", "qn").limit(limit)


def callees_of(nodes: DataFrame, edges: DataFrame, qn: str) -> DataFrame:
    """JN-3: targets by qualified name or by bare name, as two equi-joins instead of an OR."""
    out = edges.where(F.col("source") == qn).select("target").distinct()
    exact = nodes.join(out, nodes.qn == out.target, "left_semi")
    bare = nodes.join(out, nodes.name == out.target, "left_semi")
    return exact.unionByName(bare).dropDuplicates(["qn"])


def callers_of(nodes: DataFrame, edges: DataFrame, qn: str) -> DataFrame:
    """JN-4: sources of edges to the name, to its last segment, or to a member of either."""
    leaf = qn.rsplit("::", 1)[-1]
    hit = reduce(lambda a, b: a | b, [(F.col("target") == t) | F.col("target").startswith(f"{t}::") for t in dict.fromkeys((qn, leaf))])
    return nodes.join(edges.where(hit).select(F.col("source").alias("qn")).distinct(), "qn", "left_semi")


def impact(edges: DataFrame, qn: str, depth: int = 2) -> DataFrame:
    """GRF-9: nodes that reach ``qn`` within ``depth`` steps, with their least distance. One join per level; depth is at
    most 10. Each level is written in the shared folder, so the plan of the next one does not hold those before."""
    spark = edges.sparkSession
    back = edges.select(F.col("source").alias("qn"), "target")
    seen = front = spark.createDataFrame([(qn, 0)], "qn string, depth long")
    for level in range(1, min(depth, 10) + 1):
        reached = back.join(front.select(F.col("qn").alias("target")), "target").select("qn").distinct()
        front = cut(reached.join(seen.select("qn"), "qn", "left_anti").withColumn("depth", F.lit(level).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-5: edges whose target is no qualified name."""
    return edges.join(nodes, edges.target == nodes.qn, "left_anti")


def resolve_unique(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-6: unresolved targets whose bare name belongs to exactly one node are rewritten; confidence rises by 0.1."""
    unique = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("qn").alias("full")).where("n = 1")
    open_ = unresolved(nodes, edges)
    return open_.join(unique, open_.target == unique.name).select("source", F.col("full").alias("target"), F.round(F.least(F.lit(1.0), F.col("confidence") + 0.1), 6).alias("confidence"))


def outline(nodes: DataFrame, top: int = 200) -> DataFrame:
    """PRJ-4: the first symbols of each file and how many more there are."""
    w = Window.partitionBy("file").orderBy("line", "qn")
    return nodes.withColumn("place", F.row_number().over(w)).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy("file")) - top)).where(F.col("place") <= top)
