"""Event analytics: savings by layer, turn digests, loops, read-cache decisions, health (AGG, WIN, CCH, CACHE, DIG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T


def total(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def stats_by_layer(telemetry: DataFrame) -> DataFrame:
    """AGG-1: events and token sums per layer."""
    return telemetry.groupBy("layer").agg(F.count(F.lit(1)).alias("events"), total("original_tokens").alias("original_tokens"), total("compressed_tokens").alias("compressed_tokens"), total(F.col("original_tokens") - F.col("compressed_tokens")).alias("savings"))


def savings_percent(telemetry: DataFrame, *keys: str) -> DataFrame:
    """AGG-2: savings as a share of the original tokens; 0 where there are none."""
    o, s = F.sum("original_tokens"), F.sum(F.col("original_tokens") - F.col("compressed_tokens"))
    return telemetry.groupBy(*keys).agg(F.round(F.when(o > 0, 100.0 * s / o).otherwise(0.0), 6).alias("savings_pct"))


def telemetry_rollup(telemetry: DataFrame) -> DataFrame:
    return telemetry.rollup("layer", "feature").agg(F.count(F.lit(1)).alias("events"), total(F.col("original_tokens") - F.col("compressed_tokens")).alias("savings"))


def pending_by_session(turns: DataFrame) -> DataFrame:
    """FLT-7, AGG-3: turns that no digest covers yet."""
    return turns.where(F.col("rolled_up_into").isNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))


def compact(turns: DataFrame, *extra: str) -> DataFrame:
    """AGG-4: one digest row per session (and window, if named)."""
    return turns.groupBy("session_id", *extra).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), total("original_tokens").alias("original_tokens"),
        total("compressed_tokens").alias("compressed_tokens"), F.count_if(F.col("status") == "err").alias("errors"), F.min_by("tool", "turn").alias("first_tool"))


def auto_compact(turns: DataFrame, every: int = 50) -> DataFrame:
    """WIN-4: a digest for every ``every`` turns of a session; what is left over is pending (no row)."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    numbered = turns.withColumn("window_no", F.floor(place / every)).withColumn("__n", size)
    return compact(numbered.where((F.col("window_no") + 1) * every <= F.col("__n")), "window_no")


def digest_buckets(turns: DataFrame, few: int = 5, whole_commands: bool = False) -> DataFrame:
    """AGG-5: per session and bucket all targets (shell commands by first word, unless ``whole_commands``) with uses and errors,
    most used first. The execute, memory and other buckets list their first ``few`` turns; ``more`` is the number of turns not listed."""
    tools = {"read": ("Read", "NotebookRead", "mcp__crux__crux_read", "mcp__crux__crux_get_symbol_source"), "edit": ("Edit", "Write", "MultiEdit", "NotebookEdit", "Update"), "bash": ("Bash",), "search": ("Grep", "Glob", "mcp__crux__crux_search", "mcp__crux__crux_find_symbol", "mcp__crux__crux_query_graph", "mcp__crux__crux_impact"), "execute": ("mcp__crux__crux_execute",), "memory": ("mcp__crux__crux_remember", "mcp__crux__crux_recall")}
    bucket = F.coalesce(*[F.when(F.col("tool").isin(*names), name) for name, names in tools.items()], F.lit("other"))
    first = F.regexp_extract("target", r"^\s*(\S+)", 1)
    placed = turns.withColumn("bucket", bucket).withColumn("item", F.when((F.col("bucket") == "bash") & (first != "") & F.lit(not whole_commands), first).otherwise(F.col("target")))
    wrong, single = F.col("status").isin("err", "timeout"), F.col("bucket").isin("execute", "memory", "other")
    counts = placed.where(~single).groupBy("session_id", "bucket", "item").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))
    group = Window.partitionBy("session_id", "bucket")
    whole = counts.withColumn("place", F.row_number().over(group.orderBy(F.desc("n"), F.asc_nulls_last("item")))).withColumn("more", F.lit(0).cast("long"))
    each = placed.where(single).select("session_id", "bucket", "item", F.lit(1).cast("long").alias("n"), F.coalesce(wrong, F.lit(False)).cast("long").alias("errors"), F.row_number().over(group.orderBy("turn", "item")).alias("place"), F.greatest(F.count(F.lit(1)).over(group) - few, F.lit(0)).alias("more"))
    return whole.unionByName(each.where(F.col("place") <= few))


def latest_turn(turns: DataFrame) -> DataFrame:
    """WIN-5: by an aggregate, so a long session is not sorted."""
    return turns.groupBy("session_id").agg(F.max_by(F.struct("turn", "tool", "target", "status"), "turn").alias("t")).select("session_id", "t.*")


def detect_loops(messages: DataFrame, threshold: float = 0.7, history: int = 5, cap: int = 2) -> DataFrame:
    """WIN-2/3: best Jaccard match with the last ``history`` non-blank messages of the same stream; the first ``cap``
    hits of a session are flagged."""
    said = messages.withColumn("words", T.distinct_words("text", 2))
    before = F.collect_list("words").over(Window.partitionBy("session_id", "stream").orderBy("turn").rowsBetween(-history, -1))
    filled = said.where(F.trim("text") != "").withColumn("before", before)
    scored = filled.withColumn("similarity", F.round(F.coalesce(F.array_max(F.transform("before", lambda p: T.jaccard(p, F.col("words")))), F.lit(0.0)), 6))
    hits = F.sum((F.col("similarity") >= threshold).cast("int")).over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return scored.withColumn("hits", hits).select("session_id", "turn", "stream", "similarity", ((F.col("similarity") >= threshold) & (F.col("hits") <= cap)).alias("is_loop"))


def drift(versions: DataFrame) -> DataFrame:
    """WIN-6: changes of a document's hash from version to version."""
    w = Window.partitionBy("path").orderBy("version")
    changed = F.coalesce(F.col("hash") != F.lag("hash").over(w), F.lit(False))
    return versions.withColumn("changed", changed).withColumn("changes", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def read_decisions(reads: DataFrame, delta_budget: int = 50 * 1024) -> DataFrame:
    """CACHE-1: decision of each read of ``(session_id, path)`` in order: the first is allowed, an unchanged repeat is
    redundant, a changed file comes as a delta if small enough. Blocked paths never enter the cache."""
    w = Window.partitionBy("session_id", "path").orderBy("seq")
    seen = F.lag("mtime").over(w)
    decision = F.when(F.col("blocked"), "blocked").when(F.col("mtime").isNull() | seen.isNull(), "allow").when(F.abs(F.col("mtime") - seen) < 1e-3, "redundant").when(F.col("size") <= delta_budget, "delta").otherwise("allow")
    return reads.withColumn("decision", decision).withColumn("reads", F.row_number().over(w).cast("long"))


def health(facts: DataFrame) -> DataFrame:
    """CCH-1: score and grade from one row of facts per project."""
    doc = F.when(F.col("doc_tokens").isNull(), -3).when(F.col("doc_tokens") <= F.col("doc_limit"), 5).otherwise(-5)
    use = F.when(F.col("events") == 0, -2).otherwise(5)
    cache = F.when((F.col("cache_events") >= 5) & (F.col("cache_savings_pct") < 5), -3).otherwise(0)
    layers = F.when(F.col("active_layers") <= 3, -5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 75 + doc + use + cache + layers))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return facts.select("project", score.cast("long").alias("score"), grade.alias("grade"))
