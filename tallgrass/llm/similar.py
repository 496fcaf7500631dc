"""The wide step of the near-duplicate stage: texts whose sets of five-word shingles reach a Jaccard similarity of 0.8.

A radius of 2 of 64 bits, which the fingerprint join serves, holds only copies with a similarity near 1; at 0.8 some 10
bits differ, and the popcount grid has no selective cells there. This step finds partners by prefix filtering: with the
shingles of each set in one common order, two sets at 0.8 share one of their first ``n - ceil(0.8 n) + 1``, so these are
the keys and no link is missed. The order puts the shingles last that are frequent in a sample of the texts; the sample
decides how many keys are crowded, never which links are found. The exact similarity of the sets decides.

In a key all members are compared with leaders (``LEADERS`` in the first round, ``GROWTH`` times as many in each later one), but
not with those of their own group: groups are the components over all links known so far, among them those of the
fingerprint join. Leaders leave the key. A key is done when all its members are of one group, so two members that never
met are of one group. A pair is compared only if its sizes and its parity bits allow: each set has ``64 * WORDS`` bits, the
parities of its shingles' hashes; a shingle that only one of two sets has turns one bit, so the popcount of the
difference is a lower bound of the number of such shingles. A set of more shingles than that has as many bits as shingles
or more besides (a power of two, so that bits fold), which are sent for its pairs alone. No group is held in one task, and the sets stay in buckets of
their nodes: a round moves its pairs and their sets only.

Defined cases: words and case as in the fingerprints; texts with fewer words than a shingle have one shingle, the whole
sequence; texts without words have no partner here; rows of null id are left out by ``similar_links`` (``node_links`` knows
no ids); an id that is repeated with several texts is one node with the links of all of them; an empty table gives no
links. Partners are found by 64-bit hashes of shingles. Two sets are compared by 32 bits of them: for sets of n shingles
the chance that the comparison is off by one shingle is n**2 / 2**32 (2e-5 for 300).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import bucketed, gram_hashes, partitions, run_hashes, scratch, slices, span_hashes, staged, word_bounds
from tallgrass.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: The order of shingles is learned from about so many texts, and names at most so many shingles as frequent.
SAMPLE, FREQUENT = 4096, 1 << 18
#: Leaders of a key in the first round, and how many times as many each later one has.
LEADERS, GROWTH = 2, 8
#: Keys are dealt out in so many parts, one after the other: disk holds the shuffle files of one.
PARTS = 4
#: 64-bit words of a set's parity bits.
WORDS = 16
SET_NAMES, SET_SCHEMA = ("n", "grams", "keys", "bits", "more"), "n int, grams array<int>, keys array<long>, bits array<long>, more array<long>"
#: Against rounding: similarities are fractions of integers, which differ by far more.
SLACK = 1e-9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of shingle hashes (uint64, sorted) of each text in a buffer."""
    starts, ends, firsts = word_bounds(data, offsets)
    codes = span_hashes(_LOWER[data], starts, ends)
    grams = gram_hashes(codes, shingle)
    out = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            found = grams[lo : hi - shingle + 1]
        else:
            found = run_hashes(codes, np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64)
        out.append(np.unique(found))
    return out


@dataclass(frozen=True)
class Order:
    """The order in which shingles become keys: those that are frequent in a sample last, the others by hash."""

    known: np.ndarray
    counts: np.ndarray
    similarity: float = SIMILARITY

    def keys(self, found: np.ndarray) -> np.ndarray:
        """The keys of one set: its first shingles."""
        if not len(found):
            return found
        seen = np.zeros(len(found), np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            seen = np.where(self.known[at] == found, self.counts[at], 0)
        order = np.lexsort((found, seen))
        return found[order[: len(found) - math.ceil(self.similarity * len(found) - SLACK) + 1]]


def lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, dtype), *parts])))


def parities(found: np.ndarray, words: int) -> np.ndarray:
    """``64 * words`` bits (a power of two): the parities of the numbers of hashes that fall on each."""
    spots = (found >> np.uint64(20)).astype(np.int64) % (64 * words)
    return np.packbits(np.bincount(spots, minlength=64 * words) & 1).view(np.int64)


def _more(found: np.ndarray) -> np.ndarray:
    """As many parity bits as the set has hashes or more, if ``bits`` are fewer."""
    return parities(found, 1 << (len(found) - 1).bit_length() - 6) if len(found) > 64 * WORDS else np.zeros(0, np.int64)


def set_columns(sets: list[np.ndarray], order: Order) -> list[pa.ListArray]:
    """``grams`` (the upper halves of the hashes, to compare two sets) and their number ``n``, ``keys`` (whole hashes, to find
    partners), ``bits``, and ``more`` bits of large sets."""
    halves = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
    bits, more = [parities(s, WORDS) for s in sets], [_more(s) for s in sets]
    return [pa.array(np.array([len(h) for h in halves], np.int32)), lists(halves, np.int32), lists([order.keys(s).view(np.int64) for s in sets], np.int64), lists(bits, np.int64), lists(more, np.int64)]


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, order: Order) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch):
            yield pa.RecordBatch.from_arrays([rows.column(0), *set_columns(shingle_sets(data, offsets, shingle), order)], names=["doc_id", *SET_NAMES])


def _gram_counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in slices(batch, 0):
            grams = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(data, offsets, shingle)])
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])


def learned_order(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> Order:
    """The order of shingles from about ``SAMPLE`` texts, chosen by their hash."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counted = some.mapInArrow(lambda it: _gram_counts(it, shingle), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    top = counted.where("c > 1").orderBy(F.desc("c"), "gram").limit(FREQUENT).toPandas()
    known, counts = top["gram"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(known)
    return Order(known[order], counts[order], similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``pairs(a, b)`` that reach ``similarity``. ``sets`` is in buckets of its nodes, so only pairs are dealt
    out, and one set for each pair."""
    half = pairs.hint("shuffle_hash").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b")
    both = half.hint("shuffle_hash").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), "a")
    measured = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), (F.size("of_a") + F.size("of_b")).alias("both"))
    return measured.where(F.col("common") >= similarity * (F.col("both") - F.col("common")) - SLACK).select("a", "b")


def _folded(bits: F.Column, words: F.Column) -> F.Column:
    """Parity bits for half as many spots, if they are more than ``words``: each half's bits turn the other's."""
    halves = F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > words, halves).otherwise(bits)


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs, of sizes that allow a link, that all their parity bits leave possible: much less is dealt out for them
    than for whole sets. At this similarity the numbers of bits differ by a factor of two at most."""
    own = F.when(F.size("more") > 0, F.col("more")).otherwise(F.col("bits"))
    some = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), own.alias(f"{x}_bits"))
    both = pairs.hint("shuffle_hash").join(some("b"), "b").hint("shuffle_hash").join(some("a"), "a").withColumn("words", F.least(F.size("a_bits"), F.size("b_bits")))
    of_a, of_b = (_folded(F.col(f"{x}_bits"), F.col("words")) for x in "ab")
    turned = F.aggregate(F.zip_with(of_a, of_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(turned <= (F.col("a_n") + F.col("b_n")) * ((1 - similarity) / (1 + similarity)) + SLACK).select("a", "b")


def _labelled(nodes: DataFrame, parts: DataFrame, node: str, label: str) -> DataFrame:
    """``nodes`` with the group of column ``node``; a node that is not in ``parts`` is a group of its own."""
    named = parts.select(F.col("node").alias(node), F.col("component").alias(label))
    return nodes.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def _split(members: DataFrame) -> DataFrame:
    """``members(band, node, n, c)`` of the keys that have members of two groups or more, dealt out by ``band`` once (for a
    join of the members with their keys' groups Spark deals them out twice, with other columns each time)."""
    dealt, key = members.repartition(partitions(members.sparkSession), "band"), Window.partitionBy("band")
    return dealt.withColumns({"low": F.min("c").over(key), "high": F.max("c").over(key)}).where("low < high").select("band", "node", "n", "c")


def _can_link(n: F.Column, bits: F.Column, a_n: F.Column, a_bits: F.Column, similarity: float) -> F.Column:
    """Whether sizes and parity bits of two sets leave a link possible."""
    turned = sum((F.bit_count(bits[i].bitwiseXOR(a_bits[i])) for i in range(WORDS)), F.lit(0))
    return (F.least(n, a_n) >= F.greatest(n, a_n) * similarity - SLACK) & (turned <= (n + a_n) * ((1 - similarity) / (1 + similarity)) + SLACK)


def _merged(parts: DataFrame, near: DataFrame) -> DataFrame:
    """``parts`` after the links ``near(a, b)``: only groups that these links join are looked at again."""
    with scratch(parts.sparkSession) as outer:
        cross = staged(_labelled(_labelled(near, parts, "a", "x"), parts, "b", "y").where("x <> y").select("x", "y").distinct(), "cross")
        if cross.isEmpty():
            return outer.out(parts, "parts")
        joined = components(cross.select(F.col("x").alias("a"), F.col("y").alias("b")))
        alone = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
        fresh = alone.join(parts.select("node"), "node", "left_anti")
        moved = parts.join(joined.withColumnRenamed("component", "now").withColumnRenamed("node", "component"), "component", "left")
        return outer.out(moved.select("node", F.coalesce("now", "component").alias("component")).unionByName(fresh), "parts")


def node_links(sets: DataFrame, nodes: DataFrame | None = None, known: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)``: links of at least ``similarity`` that, with those ``known(a, b)``, connect all between which there are such
    links. ``sets(node, grams, keys, bits)`` is in buckets of ``node``; only ``nodes(node)`` count where these are given."""
    spark = sets.sparkSession
    with scratch(spark) as outer:
        no_links = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        parts = components(no_links if known is None else known)
        own_keys = sets.select("node", "n", "keys")
        own_keys = own_keys if nodes is None else own_keys.join(nodes.select("node"), "node", "left_semi")
        # groups are known before the keys are dealt out; the many members of the first round go without parity bits
        members = _labelled(own_keys, parts, "node", "c").select(F.explode("keys").alias("band"), "node", "n", "c")
        rest = [_split(members.where(F.pmod("band", F.lit(PARTS)) == p)).withColumn("bits", F.array_repeat(F.lit(0).cast("long"), WORDS)) for p in range(PARTS)]
        found, leaders, own = [], LEADERS, ("node", "n", "c", "bits")
        while True:
            # in buckets of their keys the members meet their leaders, and leaders leave, without another exchange
            with bucketed(rest, "band", dealt=leaders == LEADERS) as left, scratch(spark):
                if left.isEmpty():
                    break
                # of each slot of a key's groups the least node leads
                slot = F.pmod(F.xxhash64("c", F.lit(leaders)), F.lit(leaders))
                heads = left.groupBy("band", slot.alias("slot")).agg(F.min(F.struct(*own)).alias("head"))
                heads = heads.select(F.col("band").alias("key"), *[F.col(f"head.{x}").alias("a" if x == "node" else f"a_{x}") for x in own])
                may = _can_link(F.col("n"), F.col("bits"), F.col("a_n"), F.col("a_bits"), similarity)
                # compressed files say little of the heads' size (their bits above all): they never go through the driver
                met = left.join(heads.hint("merge"), (F.col("band") == F.col("key")) & (F.col("c") != F.col("a_c")) & may)
                pairs = staged(met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.greatest("n", "a_n").alias("size")).distinct(), "pairs")
                # members of the first round had no bits; later pairs of small sets have met all of theirs
                known_bits = F.lit(leaders > LEADERS) & (F.col("size") <= 64 * WORDS)
                pairs = staged(pairs.where(known_bits).select("a", "b").unionByName(_possible(pairs.where(~known_bits).select("a", "b"), sets, similarity)), "possible")
                near = outer.out(_verified(pairs, sets, similarity), "near")
                found.append(near)
                parts = outer.out(_merged(parts, near), "parts")
                # compared by their bits, nodes are no second key of the join, so the buckets serve it
                same = (F.col("band") == F.col("key")) & (F.col("node").bitwiseXOR(F.col("a")) == 0)
                others = left.select("band", "node", "n").join(heads.select("key", "a").hint("merge"), same, "left_anti")
                rest = outer.out(_split(_labelled(others, parts, "node", "c")), "rest")
            bits = sets.select("node", "bits").join(rest.select("node").distinct().hint("shuffle_hash"), "node")
            rest = rest.join(bits, "node").select("band", *own)
            leaders *= GROWTH
        links = found[0] if found else no_links
        for more in found[1:]:
            links = links.unionByName(more)
        return outer.out(links.distinct(), "links")


def similar_links(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)`` with ``a < b``: links between ids of ``docs`` (doc_id, text), each of at least ``similarity``, that
    connect all ids between which there are such links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    with scratch(docs.sparkSession) as outer:
        order = learned_order(texts, shingle, similarity)
        sketches = staged(texts.mapInArrow(lambda it: _sketch(it, shingle, order), f"doc_id long, {SET_SCHEMA}").where(F.size("grams") > 0), "sketches")
        same = ["n", "h", "g"]
        named = sketches.withColumn("h", F.xxhash64("grams")).withColumn("g", F.hash("grams"))
        firsts = staged(named.groupBy(*same).agg(F.min("doc_id").alias("a")), "firsts")
        copies = named.select("doc_id", *same).join(firsts, same).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
        own = firsts.select(F.col("a").alias("doc_id"), *same)
        sets = named.join(own, ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same]).select(F.col("doc_id").alias("node"), *SET_NAMES)
        with bucketed(sets, "node") as sets:
            links = node_links(sets, similarity=similarity)
            return outer.out(links.unionByName(copies).distinct(), "links")


def repeated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` of the documents that follow another of a smaller id in their group."""
    parts = components(similar_links(docs, shingle, similarity))
    return parts.where("node <> component").select(F.col("node").alias("doc_id"))
