"""Helpers shared by the operators of this subpackage: staged tables, Arrow slices, UTF-8 words, window routing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace that separates words everywhere here: a word is ``[^\x20\x09-\x0D]+``.
WORD_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Python slices of an Arrow batch hold about this many text bytes, so scratch arrays stay in the cache.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True


#: Where ``spark.checkpoint.dir`` is unset and all of Spark runs on this machine (tests), tables are staged here.
LOCAL_DIR = "/tmp/checkpoints"
#: The paths staged in the innermost ``scratch`` block.
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        found = LOCAL_DIR
    return found.rstrip("/")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The staged tables of a ``scratch`` block; ``out`` stages one that outlives it."""

    def __init__(self, outer: list[str] | None):
        self.outer = outer

    def out(self, df: DataFrame, label: str = "stage") -> DataFrame:
        inner = _scope.get()
        _scope.set(self.outer)
        try:
            return staged(df, label)
        finally:
            _scope.set(inner)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes at its end all tables that were staged in it; what is returned must come from ``out`` or read none of them."""
    before, own = _scope.get(), []
    _scope.set(own)
    try:
        yield Scratch(before)
    finally:
        _scope.set(before)
        _delete(spark, own)


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go at their end: their result is staged, so nobody reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tallgrass-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that outlives executors: lost tasks reread files instead of recomputing (or losing) blocks.
    """
    return restaged(df, None, label)[0]


def restaged(df: DataFrame, old: str | None, label: str = "stage") -> tuple[DataFrame, str]:
    """``df`` staged, and its path; ``old``, the path of a table that only ``df`` reads, is deleted then."""
    spark, path = df.sparkSession, _path(df.sparkSession, label)
    with _freed_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _delete(spark, [old] if old else [])
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def bucketed(df: DataFrame | list[DataFrame], column: str, dealt: bool = False) -> Iterator[DataFrame]:
    """``df`` staged in buckets of ``column``: joins on it move the other side only. The table goes at the end of the block.
    A frame already ``dealt`` out by the column is not dealt out again. Of several frames (the parts of one table) one is
    written after the other, so that the shuffle files of one part alone lie beside the table."""
    parts = df if isinstance(df, list) else [df]
    spark = parts[0].sparkSession
    name, n, path = f"tallgrass_{uuid.uuid4().hex}", partitions(spark), _path(spark, "buckets")
    with _freed_shuffles(spark):
        for part in parts:
            (part if dealt else part.repartition(n, column)).write.mode("append").bucketBy(n, column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        _delete(spark, [path])


def drop_stages(spark: SparkSession) -> None:
    """Delete all staged tables of this application; call it when no lazily read result is open any more."""
    _delete(spark, [f"{shared_dir(spark)}/tallgrass-{spark.sparkContext.applicationId}"])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns of any name cannot clash with an operator's own."""
    return docs.select(*names)


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(rows, bytes, offsets)`` of a text column in runs of about ``limit`` bytes; a null text counts as empty.

    A text longer than ``limit`` is a run of its own.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), whole[ends[i] : ends[j]], (ends[i : j + 1] - ends[i]).astype(np.int64)
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    cut = np.zeros(n + 1, bool)  # words never cross texts
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_SPACE[data]


_RANDOM = np.random.default_rng(0x7A11)
_BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to the n-th (kept for the next call)."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(max(n + 1, 1 << 19), base)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers[0][: n + 1], _powers[1][: n + 1]


def run_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of codes, the same for equal runs wherever they stand."""
    n = len(codes)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * power[:n], out=total[1:])
    return mix((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


#: Longer spans are hashed one by one.
LONG_SPAN = 4096


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal spans wherever they stand.

    The sum of a span's 8-byte blocks, each mixed with its number: unlike a polynomial of bytes modulo 2**64 it has no
    strings of any length that collide by their structure. Spans of over ``LONG_SPAN`` bytes take XXH3.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _BASE)
    if not len(size):
        return out
    blocks = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    long = np.flatnonzero(size > LONG_SPAN)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    left = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, rest, number = starts[left], size[left], 1
    total = out[left]
    who = np.arange(len(left))
    while len(who):
        block = blocks[at]
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        total[who] += mix(block + np.uint64(number * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        more = rest > 8
        who, at, rest, number = who[more], at[more] + 8, rest[more] - 8, number + 1
    out[left] = mix(total)
    return out


def gram_hashes(codes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` successive codes (a polynomial, by doubling), ``len(codes) - k + 1`` of them."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, shift, span, have, block = None, 0, 1, k, codes.astype(np.uint64, copy=False)
    while have:
        if have & 1:
            piece = block[shift : shift + n]
            out = piece if out is None else out * np.uint64(pow(int(_BASE), span, 1 << 64)) + piece
            shift += span
        have >>= 1
        if have:
            block = block[:-span] * np.uint64(pow(int(_BASE), span, 1 << 64)) + block[span:]
            span *= 2
    return mix(out ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def routes(codes: np.ndarray, firsts: np.ndarray, window: int, gram: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut all windows of ``window`` codes into runs that share a minimiser.

    The minimiser of a window is the leftmost of its ``gram``-code runs with the smallest hash, so equal windows have
    equal minimisers at equal places. Returns for each run: the text, its first window (index of a code), the number
    of windows, the minimiser's hash, and its place counted from the first window. Within a run no two windows are
    equal. Another ``seed`` gives another order of hashes.
    """
    n, none = len(codes), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, gram, seed)
    if n < window:
        return none, none, none, none.astype(np.uint64), none
    m, width = len(hashes), window - gram + 1
    low = np.uint64((1 << 28) - 1)
    best = (hashes & ~low) | np.arange(m, dtype=np.uint64)  # a slice is far below 2**28 codes
    span = 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    at = (best & low).astype(np.int64)  # of each window
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[: len(at)]
    good = np.arange(len(at)) + window <= firsts[text + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new & good)
    # a run ends at the next begin or at the last good window of its text
    last = firsts[text[begins] + 1] - window + 1
    stops = np.minimum(np.append(begins[1:], len(at)), last)
    return text[begins], begins, stops - begins, hashes[at[begins]], at[begins] - begins


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def with_columns(rows: pa.RecordBatch, names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


def n_words(text) -> F.Column:
    """Number of words, by JVM functions only; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
