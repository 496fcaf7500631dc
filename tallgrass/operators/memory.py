"""Ranked memory store: decay, recall, decay pass, grouped export (MEM, MTH, JN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T

#: Decay rate per day, floor and boost of each kind.
DECAY = (("guardrail", 1.0, 1.0, 0.0), ("user", 1.0, 0.8, 0.0), ("convention", 1.0, 0.8, 0.0), ("feedback", 0.999, 0.5, 0.1), ("decision", 0.998, 0.3, 0.1), ("error_pattern", 0.997, 0.2, 0.15), ("reference", 0.995, 0.2, 0.1), ("project", 0.99, 0.1, 0.2))


def _param(at: int, default: float) -> Column:
    """The parameter as a map lookup: eight constants need no join."""
    table = F.create_map(*[F.lit(x) for row in DECAY for x in (row[0], row[at])])
    return F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(default))


def decayed(now: int, stored: str = "relevance", last: str = "last_seen") -> Column:
    """MTH-1: max(floor, stored * rate ** days)."""
    days = F.greatest(F.lit(0), F.lit(now) - F.col(last)) / 86400.0
    return F.greatest(_param(2, 0.1), F.col(stored) * F.pow(_param(1, 1.0), days))


def remember(incoming: DataFrame) -> DataFrame:
    """MEM-1: valid observations, one per project and content hash; repeats boost relevance up to 1 and count accesses."""
    valid = incoming.where((F.trim("title") != "") & (F.trim("content") != "") & F.col("importance").between(1, 10))
    key = F.substring(F.sha2(F.concat_ws("\u0000", "project", "kind", "title", "content"), 256), 1, 32)
    boost = F.least(F.lit(1.0), F.max("relevance") + (F.count(F.lit(1)) - 1) * F.max(_param(3, 0.1)))
    return valid.withColumn("content_hash", key).groupBy("project", "content_hash").agg(F.min("id").alias("id"), F.min_by("kind", "id").alias("kind"), F.min_by("importance", "id").alias("importance"), F.round(boost, 6).alias("relevance"), (F.count(F.lit(1)) - 1).alias("access_count"))


def recall(observations: DataFrame, now: int, words: list[str] | None = None, kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
    """MEM-2: filtered by kind and by all words, the first ``limit`` by importance, then ranked by decayed score."""
    found = observations.where(~F.col("archived"))
    if kinds:
        found = found.where(F.col("kind").isin(kinds))
    for word in words or []:
        found = found.where(F.array_contains(T.distinct_words("content"), word))
    first = found.orderBy(F.desc("importance"), F.desc("relevance"), F.desc("last_seen"), "id").limit(limit)
    scored = first.withColumn("score", F.round(F.col("importance") / 5.0 * decayed(now), 6))
    return scored.select("id", "kind", "importance", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("long").alias("rank"))


def decay_pass(observations: DataFrame, now: int) -> DataFrame:
    """MEM-5: how many rows a pass scans, updates and archives."""
    new, floor = decayed(now), _param(2, 0.1)
    live = observations.where(~F.col("archived") & (_param(1, 1.0) < 1.0)).withColumn("new", new).withColumn("floor", floor)
    return live.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.abs(F.col("new") - F.col("relevance")) > 1e-6).alias("updated"), F.count_if((F.col("new") <= F.col("floor")) & (F.col("floor") < 0.2)).alias("archived"))


def top_by_kind(observations: DataFrame, top: int = 5) -> DataFrame:
    """AGG-9: the most important observations of each kind."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("importance"), F.desc("id")))
    return observations.where(~F.col("archived")).withColumn("place", rank).where(F.col("place") <= top).select("kind", "id", "importance", "place")
