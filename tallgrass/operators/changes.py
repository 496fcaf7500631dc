"""Change data: content hashes, snapshot difference, dedup, keyed upsert, delete and append (JN-8, SRC-6, SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(files: DataFrame) -> DataFrame:
    """SRC-6: hash and size of each file's content."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def difference(current: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-8: added, removed, modified or unchanged, by a full outer join on the path."""
    both = current.alias("c").join(stored.alias("s"), "path", "full_outer")
    change = F.when(F.col("s.hash").isNull(), "added").when(F.col("c.hash").isNull(), "removed").when(F.col("c.hash") != F.col("s.hash"), "modified").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def first_of_content(files: DataFrame) -> DataFrame:
    """SRCH-2/3: the first id and the number of copies of each content; hashes are shuffled, not texts."""
    return files.select("id", F.substring(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256), 1, 32).alias("content_hash")).groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-1: new rows replace stored ones of the same key."""
    return stored.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-2: only rows whose key is not stored yet."""
    return new.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti")


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-4."""
    return stored.join(gone.select(keys).distinct(), keys, "left_anti")
