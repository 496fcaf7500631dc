"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, every run of other characters than letters and digits is one space). An item of n
characters has an error budget of ``e = RATE * n`` edits. It is split into ``e + 1`` pieces: a passage within the budget
must contain one piece unchanged. One Aho-Corasick automaton finds all pieces of all items in one pass over a document;
each hit gives a window that Myers' bit-parallel algorithm verifies (semi-global edit distance of the whole item).

Scale: documents are only scanned, never shuffled. The benchmark is what travels: it is read in blocks of at most
``BLOCK_CHARS`` characters (its size is summed first), each block with an automaton of its own, so what a task holds
does not grow with the benchmark.

Defined cases: null and empty texts match nothing; items of fewer than ``LEAST_CHARS`` normalised characters are not
searched (they would hit clean text); repeated items match each by its own id; repeated rows are reported per row; other
columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import slices

RATE = 0.06
#: A piece has at least so many characters; the budget of short items shrinks accordingly.
PIECE_CHARS, LEAST_CHARS = 10, 20
BLOCK_CHARS = 4_000_000

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = RATE) -> int:
    return max(0, min(int(rate * n), n // PIECE_CHARS - 1))


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to a substring of ``text`` and the first end of one, if within ``limit``."""
    n = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = mask, 0, n, limit + 1, -1
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if best <= limit else None


class Matcher:
    """Items of a block with their pieces' automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, p, budget(len(p), rate)) for i, p in items if len(p) >= LEAST_CHARS]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, e) in enumerate(self.items):
            cuts = [round(len(text) * j / (e + 1)) for j in range(e + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, start, end)``: the best match of each item, the first of equals; normalised positions."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not self.items or len(text) < LEAST_CHARS // 2:
            return []
        for last, (size, where) in self.automaton.iter(text):
            begin = last + 1 - size
            for k, offset in where:
                _, item, e = self.items[k]
                at = begin - offset
                if (k, at) in tried or best.get(k, (1,))[0] == 0:
                    continue
                tried.add((k, at))
                n = len(item)
                if at >= 0 and text.startswith(item, at):
                    best[k] = min(best.get(k, (e + 1, 0, 0)), (0, at, at + n))
                    continue
                lo = max(0, at - e)
                window = text[lo : at + n + e]
                if len(window) < n - e or (found := myers(item, window, e)) is None:
                    continue
                distance, end = found
                back = myers(item[::-1], window[:end][::-1], distance)
                start = end - back[1] if back else 0
                best[k] = min(best.get(k, (e + 1, 0, 0)), (distance, lo + start, lo + end))
        return [(self.items[k][0], *b) for k, b in sorted(best.items())]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's normalised items, at most about ``block_chars`` characters at a time."""
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = max(1, -(-(slim.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for b in range(n):
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r.item_id, normal(r.text)) for r in part.orderBy("item_id", "text").toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, start, stop, budget``: for each document and item within budget the best match
    (positions in the normalised text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, start long, stop long, budget long"
    out = None
    for items in blocks(benchmark):
        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            allowed = {i: e for i, _, e in matcher.items}
            for batch in batches:
                for rows, data, offsets in slices(batch):
                    ids, found = rows.column(0).to_pylist(), []
                    for t in range(len(ids)):
                        found += [(ids[t], *m, allowed[m[0]]) for m in matcher.find(normal(data[offsets[t] : offsets[t + 1]].tobytes().decode()))]
                    columns = list(zip(*found, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "stop", "budget"])

        part = slim.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item within its budget; rows stay whole, nothing is joined."""
    columns = docs.columns
    for items in blocks(benchmark):
        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for rows, data, offsets in slices(batch, at):
                    clean = [not matcher.find(normal(data[offsets[t] : offsets[t + 1]].tobytes().decode())) for t in range(rows.num_rows)]
                    yield rows.filter(pa.array(np.array(clean, bool)))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.select(columns)
