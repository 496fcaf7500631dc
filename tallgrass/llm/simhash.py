"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word
shingles, repeats included. Fingerprints link at ``DISTANCE`` (2) or fewer differing bits.

Method: a fingerprint maps to the bit counts of its ``SEGMENTS`` segments. The Manhattan distance of two such vectors
is a lower bound of the Hamming distance, so linked fingerprints lie within 2 of each other on the integer grid. Two
grid points are within 2 exactly if some point is within 1 of both: the range join therefore deals every fingerprint
to its own cell and the ``2 * SEGMENTS`` neighbours at distance 1, and partners meet in a common cell. In a cell the
exact distance decides, and links are kept as a spanning forest, never as all pairs.

Exact copies collapse first: a cell holds distinct fingerprints. A cell with more than ``CELL`` of them (many near
copies of one text) is dealt on, within the cell, to the fingerprints' Hamming balls of radius 1: two fingerprints
within 2 share a point of both balls, any two that share one are within 2, and a ball holds 65 points, so that these
groups are bounded whatever the data and need no comparison at all. No candidate is dropped.

Defined cases: null and empty texts have fingerprint zero (linked like any other); texts with fewer words than a
shingle have one shingle, the whole sequence; repeated rows and ids keep one row each; a null id never names a
component unless all ids reached are null; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import bucketed, fresh, in_words, scratch, slices, staged, word_bounds
from tallgrass.llm.components import components
from tallgrass.llm.similar import SET_NAMES, SET_SCHEMA, Order, learned_order, node_links, set_columns, shingle_sets

SHINGLE, SEED, DISTANCE = 3, 42, 2
SEGMENTS = 16
CELL = 64
#: Shingles of one text that are hashed at once.
PIECE = 1 << 16
#: ``keep_one`` deals out the sets in so many parts, one after the other: disk holds the shuffle files of one.
PARTS = 4
#: ``marks``: bits for each row, and the bits at most (words of 64 go through the driver).
SPARSE, MARKS = 16, 1 << 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64, bit 63 first in the hex form) of the texts in a buffer."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, firsts = word_bounds(data, offsets)
    if not len(starts):
        return out
    # words joined by single spaces: word bytes and one space after each word
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    joined = np.full(begin[-1], 32, np.uint8)
    slot = np.ones(begin[-1], bool)
    slot[begin[1:] - 1] = False
    joined[slot] = _LOWER[data[in_words(data)]]
    text = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    for t in range(n):
        lo, hi = int(firsts[t]), int(firsts[t + 1])
        if lo == hi:
            continue
        width = min(shingle, hi - lo)
        ones, last = np.zeros(64, np.int64), hi - width + 1
        for at in range(lo, last, PIECE):
            stop = min(at + PIECE, last)
            cuts = zip(begin[at:stop].tolist(), (begin[at + width : stop + width] - 1).tolist(), strict=True)
            hashes = np.array([digest(text[a:b], SEED) for a, b in cuts], np.uint64)
            ones += np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[t] = int.from_bytes(np.packbits(ones * 2 > last - lo).tobytes(), "big")
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch):
            prints = fingerprints_of(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fingerprint(it, shingle), "doc_id long, fp long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, cell): the fingerprint's own cell and its neighbours at Manhattan distance 1, as packed bit counts."""
    width = 64 // SEGMENTS
    high = np.uint64(1 << width)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        counts = np.stack([np.bitwise_count((fps >> np.uint64(width * s)) & (high - np.uint64(1))) for s in range(SEGMENTS)], 1).astype(np.int64)
        unit = np.array([(width + 1) ** s for s in range(SEGMENTS)], np.int64)
        own = counts @ unit
        cells, who = [own], [fps]
        for s in range(SEGMENTS):
            for step, fits in ((1, counts[:, s] < width), (-1, counts[:, s] > 0)):  # beyond the grid nobody can be met
                cells.append(own[fits] + step * unit[s])
                who.append(fps[fits])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(cells))], names=["fp", "cell"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell's fingerprints (at most ``CELL``), after the exact distance."""
    for batch in batches:
        left, right = [], []
        for cell in batch.column(0).to_pylist():
            fps = np.array(sorted(cell), np.int64).view(np.uint64)
            near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE, 1))
            root = list(range(len(fps)))
            for i, j in near.tolist():
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(int(fps[i : i + 1].view(np.int64)[0]))
                    right.append(int(fps[j : j + 1].view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _met(prints: DataFrame) -> DataFrame:
    """``(cell, fp, n)``: fingerprints in cells of ``n > 1``. Spark takes the cells for as small as the fingerprints that they
    are made of (a thirty-third), so both sides are dealt out by hint: else it may send them all through the driver."""
    cells = prints.mapInArrow(_cells, "fp long, cell long")
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cells.join(shared.hint("merge"), "cell")


def _balls(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links among the fingerprints that share a point of their Hamming balls of radius 1; the least one of a point
    links to the others. Dealt out by hint, since the balls count as a sixty-fifth of their rows."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)])
    balls = prints.select("fp", F.explode(flips).alias("point"))
    heads = balls.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    return balls.join(heads.hint("merge"), "point").select("a", F.col("fp").alias("b")).where("a <> b")


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints ``fp`` within ``DISTANCE`` bits (a spanning set)."""
    with scratch(prints.sparkSession) as outer:
        met = staged(_met(prints), "cells")
        small = met.where(F.col("n") <= CELL).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forest, "a long, b long")
        large = _balls(met.where(F.col("n") > CELL).select("fp").distinct())
        return outer.out(small.unionByName(large).distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id, n_links`` per row of ``docs``: the component's least id, and the number of stored links
    of the fingerprint's spanning set (0: alone)."""
    with scratch(docs.sparkSession) as outer:
        prints = outer.out(fingerprint(docs, shingle), "prints")
        distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        edges = links(distinct.select("fp"))
        parts = components(edges)
        # the least id of each component of fingerprints
        named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
        ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
        degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
        labels = outer.out(named.join(ids, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "n_links")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, F.lit("0")))


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, ranks: Order) -> Iterator[pa.RecordBatch]:
    """Fingerprint and wide shingle set of each text; of equal texts of a slice the first alone has the set."""
    for batch in batches:
        for rows, data, offsets in slices(batch, 3):
            prints, sets = fingerprints_of(data, offsets, shingle), shingle_sets(data, offsets)
            one, two = (rows.column(k).to_numpy() for k in (1, 2))
            order = np.lexsort((two, one))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            sets = [s[:0] if repeat else s for s, repeat in zip(sets, again.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(prints.view(np.int64)), pa.array(~again), *set_columns(sets, ranks)], names=["doc_id", "k1", "k2", "fp", "head", *SET_NAMES])


def _text_keys(text) -> tuple[F.Column, F.Column]:
    """Two 64-bit hashes of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def marks(rows: DataFrame, hashed: F.Column) -> tuple[DataFrame, int]:
    """``(word, bits)``: a bitmap of the rows' hashes, one bit each, and its size in bits. A hash whose bit is not set is
    none of theirs; others may share a bit. However many rows there are, the bitmap is small enough to broadcast."""
    size = min(MARKS, 1 << max(6, (SPARSE * rows.count() - 1).bit_length()))
    spots = rows.select(F.pmod(hashed, F.lit(size)).alias("spot"))
    return spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("bits")), size


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row per group of near duplicates.

    Nodes are distinct texts (null is the empty one). Groups are the components over the links of the fingerprint join and
    those of ``similar`` (five words, 0.8), both over all nodes. The row of the group's least id stays; of several rows with
    that id the one of the least text hash; of equal rows (id and text) one, whichever. Repeated ids with unlike texts are
    rows of their own; rows without id stay. Other columns pass through, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    k1, k2 = _text_keys(F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    order = learned_order(docs)

    def part(p: int) -> DataFrame:
        """Sets of the texts of one part, all copies of a text among them; the numbers of its nodes are no other part's."""
        some = slim.where(F.pmod("k1", F.lit(PARTS)) == p)
        sketch = some.mapInArrow(lambda it: _sketch(it, shingle, order), f"doc_id long, k1 long, k2 long, fp long, head boolean, {SET_SCHEMA}")
        return sketch.withColumn("node", F.monotonically_increasing_id() * PARTS + p)

    with scratch(spark) as outer, bucketed([part(p) for p in range(PARTS)], "node") as sets:
        rows = staged(sets.groupBy("doc_id", "k1", "k2").agg(F.min(F.when(F.col("head"), F.col("node"))).alias("node"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "rows")
        nodes = staged(rows.groupBy("k1", "k2").agg(F.min("node").alias("node"), F.min("fp").alias("fp")), "nodes")
        parts = components(links(nodes.select("fp").distinct()))
        named = staged(nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("component", "fp").alias("root")), "named")
        narrow = named.join(named.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z"), "root").select("a", F.col("node").alias("b")).where("a <> b")
        narrow = staged(narrow, "narrow")
        wide = node_links(sets.where(F.size("grams") > 0).select("node", *SET_NAMES), nodes, narrow)
        parts = components(narrow.unionByName(wide))
        grouped = rows.drop("node").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
        grouped = staged(grouped.select("doc_id", "k1", "k2", "n", "root"), "grouped")
        place = F.struct("doc_id", "k1", "k2")
        best = grouped.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("members"), F.max("n").alias("most")).where("members > 1 OR most > 1")
        judged = grouped.join(best, "root").select("doc_id", "k1", "k2", "n", (place == F.col("best")).alias("stays"))
        judged = staged(judged, "judged")
        gone = outer.out(judged.where("NOT stays OR n > 1").select("doc_id", "k1", "k2"), "gone")
        twice = outer.out(judged.where("stays AND n > 1").select("doc_id", "k1", "k2"), "twice")
    # texts stay where they are unless a bitmap says that they may go: only those are dealt out for the join that decides
    bitmap, size = marks(gone, F.xxhash64("doc_id", "k1", "k2"))
    names = [fresh(docs, n) for n in ("k1", "k2", "spot", "word", "bits")]
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), k1, k2), F.lit(size))
    keyed = docs.withColumns(dict(zip(names, (k1, k2, spot), strict=False)))
    bitmap = bitmap.select(F.col("word").alias(names[3]), F.col("bits").alias(names[4]))
    keyed = keyed.join(F.broadcast(bitmap), F.shiftright(names[2], 6) == F.col(names[3]), "left")
    marked = F.coalesce(F.getbit(names[4], F.col(names[2]).bitwiseAND(63).cast("int")) == 1, F.lit(False))
    may_go = keyed.where(marked)

    def same(keys: DataFrame) -> F.Column:
        return (may_go["doc_id"].cast("long") == keys["doc_id"]) & (may_go[names[0]] == keys["k1"]) & (may_go[names[1]] == keys["k2"])

    kept = keyed.where(~marked).union(may_go.join(gone, same(gone), "left_anti"))
    if not twice.isEmpty():
        kept = kept.union(may_go.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", *names[:2]]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
