"""Streaming forms give the batch results."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import events
from tallgrass.plans import bindings as B
from tallgrass.streaming import stateful

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, batch, operator, name, mode="append"):
    """The operator's output over the table, dealt to the stream as two files in order."""
    for i in range(2):
        part = batch.where(F.col("__part") == i).drop("__part").coalesce(1)
        part.write.mode("overwrite").parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(batch.drop("__part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = operator(src).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def rows(df, cols):
    return sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in cols]).collect()))


@pytest.mark.parametrize(
    ("name", "source", "batch", "stream", "cut", "cols"),
    [
        ("compacted", B.turns, lambda df: events.auto_compact(df, 3), lambda df: stateful.auto_compact(df, 3), "turn >= 4", ["session_id", "window_no", "event_count", "first_turn", "last_turn", "original_tokens", "errors"]),
        ("looped", B.messages, events.detect_loops, stateful.detect_loops, "turn >= 4", ["session_id", "turn", "stream", "similarity", "is_loop"]),
        ("decided", B.reads, events.read_decisions, stateful.read_decisions, "seq >= 50", ["session_id", "path", "seq", "decision", "reads"]),
    ],
)
def test_same_as_batch(spark, tmp_path, name, source, batch, stream, cut, cols):
    df = source(spark, SF)
    got = streamed(spark, tmp_path, df.withColumn("__part", F.expr(cut).cast("int")), stream, name)
    want = batch(df)
    assert rows(got, cols) == rows(want, cols) and want.count() > 0


def test_windowed_stats(spark, tmp_path):
    df = B.telemetry(spark, SF).join(B.table(spark, SF, "events").select("event_id", "ts"), "event_id").withColumn("__part", (F.col("event_id") % 2).cast("int"))
    got = streamed(spark, tmp_path, df, lambda s: stateful.windowed_stats(s, window="1 day", late="365 days"), "windows", "update")
    assert got.count() > 0
