"""Removal of repeated word windows (FM-index) and repeated byte strings (suffix array).

Both operators remove the tokens covered by a window of ``window`` successive tokens (words or bytes) that also starts
earlier in the corpus. The corpus is never searched against itself; windows are routed so that equal ones meet:

1. Routing. Each text's windows are cut into runs that share a minimiser (see ``common.routes``). Equal windows have
   equal minimisers, so a window can only repeat among runs of one minimiser. One row per run, about a sixth of the
   words or a fortieth of the bytes, counts the minimisers (partial sums before the shuffle).
2. Runs of a minimiser seen once are dropped. Where all runs of a minimiser have the same content, every run but the
   first is a repeat as a whole. That settles exact copies without shipping text, however large their groups are.
3. Only runs of minimisers with different contents (the borders of repeated passages) are shipped with their text, one
   per content, to bounded shards. A shard finds the equal windows: the byte operator by a suffix array built by
   grouping (``suffixes.suffix_array``), the word operator by a compressed FM-index that the runs are streamed against
   (``suffixes.FMIndex``).
   A minimiser with more than ``HOT`` contents would make a shard too large; its runs are cut again by another order of
   hashes, up to ``LEVELS`` times, which spreads them. Windows of what is still crowded are dealt singly by their own
   content, where the first of equal windows is a minimum (pre-summed), so no group is gathered at all.
4. The covered intervals of a text are gathered by its id (bounded by the text's own length) and cut out.

Texts are zstd-compressed while they are shuffled by id. Rows are identified by id and a hash of the text.

Order of documents: by id; rows of the same id are one document (nothing in them repeats from one another for words;
equal places are no repeats for bytes); a null id is after all others.
Defined cases: a null text is empty; texts shorter than a window keep all; an empty table gives no rows; repeated rows
get the same result each; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import _BYTE_CODE, partitions, routes, run_hashes, slices, span_hashes, staged, word_bounds
from tallgrass.llm.suffixes import FMIndex, equal_windows

#: More contents of one minimiser than this are dealt by window; a shard's text is about so many bytes.
HOT, SHARD_TEXT = 500, 1 << 20
#: Times that a crowded minimiser's runs are cut again before its windows are dealt singly; largest group tried in pairs.
LEVELS, PAIRS = 4, 100
NULL_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    words: bool
    window: int
    gram: int


WORDS, BYTES = Kind(True, 13, 6), Kind(False, 100, 32)


class Tokens:
    """The tokens of a slice: a code for each, and the first token of each text."""

    def __init__(self, kind: Kind, data: np.ndarray, offsets: np.ndarray):
        if kind.words:
            starts, ends, self.firsts = word_bounds(data, offsets)
            self.codes = span_hashes(data, starts, ends)
        else:
            self.codes, self.firsts = _BYTE_CODE[data], offsets


def _parts(kind: Kind, text: bytes) -> bytes | list[bytes]:
    """The tokens of one text: its bytes, or its words (``bytes.split`` splits at the six ASCII spaces)."""
    return text.split() if kind.words else text


def _runs(batches: Iterator[pa.RecordBatch], kind: Kind, bodies: bool) -> Iterator[pa.RecordBatch]:
    """One row per run. ``bodies``: for the counts of minimisers (hashes of the runs), else for the runs themselves."""
    for batch in batches:
        for rows, data, offsets in slices(batch, 2):
            tokens = Tokens(kind, data, offsets)
            text, begin, n, mini, at = routes(tokens.codes, tokens.firsts, kind.window, kind.gram)
            take = pa.array(text)
            place = (begin - tokens.firsts[text]).astype(np.int32)
            first = [pa.array(mini.view(np.int64)), rows.column(0).take(take), pa.array(place)]
            if bodies:  # the minimiser's own place: runs of one start may hold it at different ones
                body, first[2] = run_hashes(tokens.codes, begin, begin + n + kind.window - 1), pa.array((place + at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*first, pa.array(body.view(np.int64))], names=["mini", "id", "place", "body"])
            else:
                yield pa.RecordBatch.from_arrays([*first, rows.column(1).take(take), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=["mini", "id", "start", "th", "n", "at"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for rows, data, offsets in slices(batch, 2):
            texts = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.binary()), rows.column(3)], names=["id", "th", "packed", "doc_id"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    inflate = zstandard.ZstdDecompressor()
    for i, body in enumerate(batch.column("packed")):
        yield i, inflate.decompress(body.as_buffer())


def _bodies(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The candidate runs of each text with their content."""
    for batch in batches:
        ids, ths, runs = batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("runs")
        cuts, flat = (runs.offsets.to_numpy() - runs.offsets[0].as_py()).tolist(), runs.flatten()
        minis, starts, sizes, places = (flat.field(c).to_pylist() for c in ("mini", "start", "n", "at"))
        out, held = [], 0
        for i, text in _unpacked(batch):
            tokens = _parts(kind, text)
            for r in range(cuts[i], cuts[i + 1]):
                body = tokens[starts[r] : starts[r] + sizes[r] + kind.window - 1]
                body = b" ".join(body) if kind.words else body
                out.append((minis[r], xxhash.xxh3_128_digest(body), ids[i], starts[r], sizes[r], places[r], ths[i], body))
                held += len(body)
            if held > 1 << 22:
                yield _body_batch(out)
                out, held = [], 0
        yield _body_batch(out)


def _body_batch(out: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["mini", "key", "id", "start", "n", "at", "th", "body"]
    columns = list(zip(*out, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


BODY_SCHEMA = "mini long, key binary, id long, start int, n int, at int, th long, body binary"


def _recut(batches: Iterator[pa.RecordBatch], kind: Kind, level: int) -> Iterator[pa.RecordBatch]:
    """The runs of crowded minimisers cut again by another order of hashes, as runs of their own."""
    for batch in batches:
        out = []
        for id_, start, th, body in zip(*[batch.column(c).to_pylist() for c in ("id", "start", "th", "body")], strict=True):
            data = np.frombuffer(body, np.uint8)
            tokens, parts = Tokens(kind, data, np.array([0, len(data)])), _parts(kind, body)
            for _, begin, n, mini, at in zip(*[x.tolist() for x in routes(tokens.codes, tokens.firsts, kind.window, kind.gram, level)], strict=True):
                part = parts[begin : begin + n + kind.window - 1]
                part = b" ".join(part) if kind.words else part
                out.append((mini - (1 << 64) if mini >> 63 else mini, xxhash.xxh3_128_digest(part), id_, start + begin, n, at, th, part))
        yield _body_batch(out)


def _shared(left: bytes, right: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(left), len(right))
    if left[:hi] == right[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if left[lo:mid] == right[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _partnered(bodies: list[bytes], places: list[int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """What the contents of one minimiser may share: texts, each with its (content, place in it).

    Equal windows have the minimiser at the same place, so what two contents share around it must be as long as a
    window, and a content is cut down to what it shares with any other. In large groups all are taken whole.
    """
    reach: dict[int, tuple[int, int]] = {}
    if len(bodies) > PAIRS:
        reach = {i: (p, len(b) - p) for i, (b, p) in enumerate(zip(bodies, places, strict=True))}
    else:
        before, after = [b[:p][::-1] for b, p in zip(bodies, places, strict=True)], [b[p:] for b, p in zip(bodies, places, strict=True)]
        for i in range(len(bodies)):
            for j in range(i):
                x, y = _shared(before[i], before[j]), _shared(after[i], after[j])
                if x + y >= window:
                    for k in (i, j):
                        u, v = reach.get(k, (0, 0))
                        reach[k] = max(u, x), max(v, y)
    texts: dict[bytes, list[tuple[int, int]]] = {}
    for i, (x, y) in sorted(reach.items()):
        texts.setdefault(bodies[i][places[i] - x : places[i] + y], []).append((i, places[i] - x))
    return texts


def _solve(pdf: pd.DataFrame, kind: Kind) -> pd.DataFrame:
    """(key, spans): of each content of a shard, the window ranges that start earlier elsewhere in the shard."""
    pdf = pdf.sort_values(["mini", "id", "start"]).reset_index(drop=True)
    ids, starts = pdf["id"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64)
    repeats: list[list[int]] = [[] for _ in range(len(pdf))]
    if kind.words:
        tokens = [b.split(b" ") for b in pdf["body"]]
        codes = pd.factorize(np.array([w for t in tokens for w in t], object))[0]
        cuts = np.cumsum([len(t) for t in tokens])
        sequences = np.split(codes.astype(np.int64), cuts[:-1])
        index = FMIndex(sequences, int(codes.max()) + 1, kind.window)
        owner = np.repeat(np.append(ids, NULL_ID), np.append([len(s) + 1 for s in sequences], 0))
        least = np.repeat(np.minimum.reduceat(owner[index.order], index.whole), np.diff(np.append(index.whole, index.n)))
        index.order = None  # only the compressed index is searched
        for who, at, lo, _ in index.stream(sequences):
            again = least[lo] < ids[who]
            for w, a in zip(who[again].tolist(), at[again].tolist(), strict=True):
                repeats[w].append(a)
    else:
        minis = pdf["mini"].to_numpy()
        cuts = np.flatnonzero(np.append(True, minis[1:] != minis[:-1]))
        bodies, places = pdf["body"].tolist(), pdf["at"].tolist()
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pdf)], strict=True):
            texts = _partnered(bodies[a:b], places[a:b], kind.window)
            owners = list(texts.values())
            for group in equal_windows(list(texts), kind.window, [len(o) > 1 for o in owners]) if texts else []:
                found = [(a + i, starts[a + i] + at + place) for s, place in group for i, at in owners[s]]
                first = min((ids[i], where) for i, where in found)
                for i, where in found:
                    if (ids[i], where) > first:
                        repeats[i].append(where - starts[i])
    spans = []
    for r in repeats:
        r = np.unique(np.array(r, np.int64))
        if len(r):
            new = np.flatnonzero(np.append(True, np.diff(r) > 1))
            spans.append([{"a": int(x), "b": int(y) + 1} for x, y in zip(r[new], r[np.append(new[1:], len(r)) - 1], strict=True)])
        else:
            spans.append([])
    return pd.DataFrame({"mini": pdf["mini"], "key": pdf["key"], "spans": spans})


def _windows(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Single windows of hot minimisers' contents: (mini, key, at, window hash, id, place)."""
    for batch in batches:
        out = []
        for mini, key, id_, start, n, body in zip(*[batch.column(c).to_pylist() for c in ("mini", "key", "id", "start", "n", "body")], strict=True):
            words = body.split(b" ") if kind.words else None
            for i in range(n):
                part = b" ".join(words[i : i + kind.window]) if kind.words else body[i : i + kind.window]
                out.append((mini, key, i, xxhash.xxh3_128_digest(part), id_, start + i))
        types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["mini", "key", "at", "window", "id", "place"])


def _ranked(bodies: DataFrame) -> DataFrame:
    """The first run of each content with the number of contents of its minimiser."""
    firsts = bodies.groupBy("mini", "key").agg(F.min(F.struct("id", "start", "n", "at", "th", "body")).alias("f")).select("mini", "key", "f.*")
    crowd = bodies.select("mini", "key").distinct().groupBy("mini").agg(F.count(F.lit(1)).alias("contents"))
    return staged(firsts.join(crowd, "mini").withColumn("level", F.lit(0)), "firsts")


def covered(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """The packed texts ``(id, th, packed, doc_id)`` and the covered window ranges ``(id, th, a, b)``: windows a to b - 1
    of a text repeat."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    runs = slim.select("id", "th", "text")
    counted = runs.mapInArrow(lambda it: _runs(it, kind, True), "mini long, id long, place int, body long")
    place = F.struct("id", "place")
    minis = counted.groupBy("mini").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min(place).alias("first"), F.max(place).alias("last"))
    if kind.words:  # only documents count, not places in them
        seen, later = minis.where("first.id < last.id"), F.col("id") > F.col("first.id")
    else:
        seen, later = minis.where("first < last"), F.struct("id", (F.col("start") + F.col("at")).alias("place")) > F.col("first")
    seen = seen.select("mini", "first", (F.col("low") != F.col("high")).alias("mixed"))
    met = staged(runs.mapInArrow(lambda it: _runs(it, kind, False), "mini long, id long, start int, th long, n int, at int").join(seen, "mini"), "runs")
    whole = met.where(~F.col("mixed") & later).select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    packed = slim.mapInArrow(_pack, "id long, th long, packed binary, doc_id long")
    # texts of mixed minimisers' runs
    lists = met.where("mixed").select("id", "th", F.struct("mini", "start", "n", "at").alias("run")).distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    texts = packed.select("id", "th", "packed").join(lists, ["id", "th"])
    bodies = staged(texts.mapInArrow(lambda it: _bodies(it, kind), BODY_SCHEMA), "bodies")
    ranked = _ranked(bodies)
    crowded, all_bodies, all_ranked = ranked, bodies, ranked
    for level in range(1, LEVELS + 1):
        crowded = crowded.where(F.col("contents") > HOT)
        if crowded.isEmpty():
            break
        again = staged(crowded.select("id", "start", "th", "body").mapInArrow(lambda it, level=level: _recut(it, kind, level), BODY_SCHEMA), "recut")
        crowded = _ranked(again).withColumn("level", F.lit(level))
        all_bodies, all_ranked = all_bodies.unionByName(again), all_ranked.unionByName(crowded)
    bodies = all_bodies
    # runs that were cut again are answered by their parts; only those of the last level go on as windows
    ranked = all_ranked.withColumn("way", F.when(F.col("contents") <= HOT, "shard").when(F.col("level") < LEVELS, "parts").otherwise("windows"))
    volume = ranked.where("way = 'shard'").agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(partitions(spark), int(volume // SHARD_TEXT) + 1)
    spans = "mini long, key binary, spans array<struct<a:int,b:int>>"
    # a content alone of its minimiser has nothing to be compared with
    some = ranked.where("way = 'shard' and contents > 1").withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).repartition(shards, "shard")
    solved = some.groupBy("shard").applyInPandas(lambda pdf: _solve(pdf, kind), spans)
    single = ranked.where("way = 'windows'").select("mini", "key", "id", "start", "n", "body").mapInArrow(lambda it: _windows(it, kind), "mini long, key binary, at int, window binary, id long, place long")
    order = F.col("id").cast("decimal(38,0)") * F.lit(1 << 31) + (F.lit(0) if kind.words else F.col("place"))
    least = single.groupBy("window").agg(F.min(order).alias("least"))
    dealt = single.withColumn("order", order).join(least, "window").where("least < order").groupBy("mini", "key").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))
    answers = staged(solved.unionByName(dealt).withColumnRenamed("mini", "m").withColumnRenamed("key", "k"), "answers")
    heads = ranked.select(F.col("mini").alias("hm"), F.col("key").alias("hk"), F.col("id").alias("head_id"), F.col("start").alias("head_start"))
    book = staged(heads.join(answers, (F.col("hm") == F.col("m")) & (F.col("hk") == F.col("k")), "left").select("hm", "hk", "head_id", "head_start", "spans"), "book")
    placed = bodies.drop("body").join(book, (F.col("mini") == F.col("hm")) & (F.col("key") == F.col("hk")))
    place = F.struct("id", "start")
    later = F.col("id") > F.col("head_id") if kind.words else place > F.struct(F.col("head_id").alias("id"), F.col("head_start").alias("start"))
    parts = F.when(later, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))).otherwise(F.col("spans"))
    cut = placed.select("id", "th", "start", F.explode(parts).alias("s")).select("id", "th", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    return packed, whole.unionByName(cut)


def _cut(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, rows = batch.column("spans"), []
        cuts, flat = (spans.offsets.to_numpy() - spans.offsets[0].as_py()).tolist(), spans.flatten()
        begins, stops = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        for i, text in _unpacked(batch):
            tokens, found = _parts(kind, text), cuts[i + 1] > cuts[i]
            n, kept = len(tokens), tokens
            gone = np.zeros(n, bool)
            if found:
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, begins[cuts[i] : cuts[i + 1]], 1)
                np.add.at(edge, stops[cuts[i] : cuts[i + 1]] + (kind.window - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = list(compress(tokens, (~gone).tolist())) if kind.words else np.frombuffer(text, np.uint8)[~gone].tobytes()
            if kind.words:
                kept = b" ".join(kept)
            runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
            rows.append((n, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]], names=["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, kind: Kind) -> DataFrame:
    """``doc_id, n_tokens, n_removed, n_spans, kept_sha256`` of each row of ``docs``."""
    packed, cut = covered(docs, kind)
    spans = staged(cut, "cut").groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return packed.join(spans, ["id", "th"], "left").select("doc_id", "packed", "spans").mapInArrow(lambda it: _cut(it, kind), "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string")


def dedup_words(docs: DataFrame) -> DataFrame:
    return dedup(docs, WORDS).withColumnRenamed("n_tokens", "n_words")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    return dedup(docs, BYTES).withColumnRenamed("n_tokens", "n_bytes")
