"""Sinks: renderings of results, and the markdown export of observations (SNK-6, SNK-8, AGG-9, MEM-6)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "<!-- generated file: changes will be lost -->"
STAMP = "<!-- generated at "


def ndjson(df: DataFrame) -> DataFrame:
    """SNK-8: every row as one JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown(observations: DataFrame, kinds: tuple[str, ...], top: int = 200) -> DataFrame:
    """MEM-6: one section per kind in the given order: ``kind, place, n, body``. Items by importance, then newest id;
    at most ``top`` a kind, the number of the others is stated."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("importance"), F.desc("id")))
    ranked = observations.where(~F.col("archived")).withColumn("place", place).where("place > 0").withColumn("r", order)
    line = F.concat(F.lit("- ["), F.col("importance").cast("string"), F.lit("] "), F.regexp_replace(F.coalesce("title", F.lit("")), "\\s+", " "))
    parts = ranked.groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", line.alias("line"))))).alias("items"))
    more = F.when(F.col("n") > top, F.format_string("\n- … and %d more", F.col("n") - top)).otherwise("")
    return parts.select("kind", "place", "n", F.concat(F.lit("## "), F.col("kind"), F.lit("\n\n"), F.array_join("items.line", "\n"), more).alias("body"))


def export_markdown(observations: DataFrame, kinds: tuple[str, ...], target: str, now: str, top: int = 200) -> str:
    """SNK-6: writes the export to ``target`` by a temporary file and a rename. Says ``refused`` if a file written by hand is
    there, ``unchanged`` if only the time would differ, else ``written``. At most ``top`` items a kind reach the driver."""
    sections = [r.body for r in markdown(observations, kinds, top).orderBy("place").collect()]
    text = "\n".join([MARK, f"{STAMP}{now} -->", "", "\n\n".join(sections), ""])
    path = Path(target)
    if path.exists():
        old = path.read_text("utf-8")
        if not old.startswith(MARK):
            return "refused"
        bare = lambda t: [x for x in t.split("\n") if not x.startswith(STAMP)]
        if bare(old) == bare(text):
            return "unchanged"
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    part.replace(path)
    return "written"
