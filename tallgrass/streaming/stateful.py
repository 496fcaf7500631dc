"""Streaming forms of the session operators (STM-1..4): bounded state per key, watermarked windows.

State per key is a few numbers or at most ``history`` short messages, so it does not grow with the stream. Within a
micro-batch the rows of a key are taken in the order of ``seq``; across batches the order of arrival holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_WORD = re.compile(r"[^\W]+")


def windowed_stats(telemetry: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """STM-1: events and savings per time window and layer; events later than ``late`` do not count."""
    saved = F.coalesce(F.sum(F.col("original_tokens") - F.col("compressed_tokens")), F.lit(0)).cast("long")
    marked = telemetry.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    return marked.groupBy(F.window("__ts", window), "layer").agg(F.count(F.lit(1)).alias("events"), saved.alias("savings")).select(F.col("window.start").alias("start"), "layer", "events", "savings")


def _in_order(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


_DIGEST = "session_id string, window_no long, event_count long, first_turn long, last_turn long, original_tokens long, compressed_tokens long, errors long"


def auto_compact(turns: DataFrame, every: int = 50) -> DataFrame:
    """STM-2: a digest row whenever ``every`` turns of a session are pending; the state holds the pending sums."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, first, original, compressed, errors = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        out = []
        for r in _in_order(batches, "turn").itertuples():
            first = r.turn if n == 0 else first
            n, original, compressed, errors = n + 1, original + int(r.original_tokens or 0), compressed + int(r.compressed_tokens or 0), errors + (r.status == "err")
            if n == every:
                out.append((key[0], window, n, first, r.turn, original, compressed, errors))
                window, n, first, original, compressed, errors = window + 1, 0, 0, 0, 0, 0
        state.update((window, n, int(first), original, compressed, int(errors)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST.split(", ")])

    rows = turns.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "status", F.coalesce("original_tokens", F.lit(0)).alias("original_tokens"), F.coalesce("compressed_tokens", F.lit(0)).alias("compressed_tokens"))
    return rows.groupBy("session_id").applyInPandasWithState(step, _DIGEST, "window_no long, n long, first long, original long, compressed long, errors long", "append", GroupStateTimeout.NoTimeout)


_LOOP = "session_id string, turn long, stream string, similarity double, is_loop boolean"


def detect_loops(messages: DataFrame, threshold: float = 0.7, history: int = 5, cap: int = 2) -> DataFrame:
    """STM-3: the best Jaccard match with the last ``history`` messages of the stream; the first ``cap`` hits of a
    session are flagged. Blank messages give no row and are not remembered."""

    def words(text: str) -> frozenset[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return frozenset(w for w in _WORD.findall(low) if len(w) >= 2)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, streams, texts = state.get if state.exists else (0, [], [])
        past = list(zip(streams, texts, strict=True))
        out = []
        for r in _in_order(batches, "turn").itertuples():
            if not (r.text or "").strip():
                continue
            own = words(r.text)
            best = max((len(own & old) / len(own | old) if own | old else 0.0 for old in (words(t) for s, t in past if s == r.stream)), default=0.0)
            hit = round(best, 6) >= threshold
            hits += hit
            out.append((key[0], r.turn, r.stream, round(best, 6), bool(hit and hits <= cap)))
            same = [i for i, (s, _) in enumerate(past) if s == r.stream]
            if len(same) >= history:
                del past[same[0]]
            past.append((r.stream, r.text))
        state.update((int(hits), [s for s, _ in past], [t for _, t in past]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _LOOP.split(", ")])

    rows = messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "stream", "text")
    return rows.groupBy("session_id").applyInPandasWithState(step, _LOOP, "hits long, streams array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout)


_READ = "session_id string, path string, seq long, decision string, reads long"


def read_decisions(reads: DataFrame, delta_budget: int = 50 * 1024) -> DataFrame:
    """STM-4: decision of each read of ``(session_id, path)`` as in the batch form; the state is the last time and the
    number of reads."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, known, n = state.get if state.exists else (0.0, False, 0)
        out = []
        for r in _in_order(batches, "seq").itertuples():
            n += 1
            missing = r.mtime is None or r.mtime != r.mtime
            if r.blocked:
                decision = "blocked"
            elif missing or not known:
                decision = "allow"
            elif abs(r.mtime - seen) < 1e-3:
                decision = "redundant"
            else:
                decision = "delta" if r.size <= delta_budget else "allow"
            seen, known = (0.0, False) if missing else (float(r.mtime), True)
            out.append((*key, r.seq, decision, n))
        state.update((seen, known, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])

    rows = reads.select(F.col("session_id").cast("string").alias("session_id"), "path", F.col("seq").cast("long").alias("seq"), F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return rows.groupBy("session_id", "path").applyInPandasWithState(step, _READ, "seen double, known boolean, n long", "append", GroupStateTimeout.NoTimeout)
