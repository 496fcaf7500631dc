"""Mixing sources to target weights by subset-sum budget fitting.

Sources sort by code point, null last. Their weights ``WEIGHTS`` repeat in that order and share ``SHARE`` of all words;
a target stops at ``REPEATS`` times its source's size, and the excess is shared again by weight until none is above.

For each source, every document is taken ``floor(target / size)`` times. The rest of the budget is a subset-sum
problem over document lengths: documents are counted by exact length; each length first gives the same fraction of its
documents, then one more from long to short while it fits, and the last words (``BUDGET`` at first) are fitted by a
bounded-knapsack dynamic programme over the lengths still left. While the budget is not met, documents are given back
and the programme gets twice the words, up to the whole budget: the sum is always the best from below. Of each length
the planned number of documents is chosen in the order of a seeded hash, so reruns agree.

Scale: a source is planned from its length histogram, whose rows are distinct lengths, never documents. The seeded
choice needs one number for each length, the hash up to which documents are taken; it is found from counts by hash
prefix and then by the hashes of the one prefix that the number falls in. Documents are only joined to the plan, one row
for each source and length. Source totals are ranked by range partitions and reshared by single-row sums.

Defined cases: a null text has no words; a document without words is never taken; null sources are one source, last in
order; the hash is of id and text, so of repeated rows any may be the one taken (those of one hash at the cut are ranked in
one task); a null id hashes as a text of its own; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import fresh, n_words, scratch, staged

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
#: Words that the dynamic programme fits in its first attempt, and the leading bits of the hash by which the documents of a
#: length are counted before single hashes are.
BUDGET, SLOT_BITS = 4096, 12
#: Lengths of all sources together (about 80 bytes each) up to which the plan is broadcast.
BROADCAST_ROWS = 1 << 18
SEED = 17


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """One attempt: all but about ``window`` words by even share and greedily, the rest by the dynamic programme. The sum
    is the best that can be reached from below if it is the budget, or if the window holds the whole budget."""
    total = int((lengths * counts).sum())
    # a budget that the dynamic programme can fit as a whole needs no even share first
    share = 0 if budget <= window else budget if window <= BUDGET else budget - window
    taken = np.array([int(c) * share // total for c in counts], np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= window:
            break
        more = min(int(counts[i] - taken[i]), 1 if rest < 4 * window else rest // int(lengths[i]), rest // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    for i in order:  # whatever is still far off goes by the longest that fit
        if rest <= window:
            break
        more = min(int(counts[i] - taken[i]), max(0, rest - window // 2) // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    # bounded knapsack: the item that reaches a sum first; what it was added to was reached before it
    rest = min(rest, window)
    by = np.full(rest + 1, -1, np.int32)
    by[0], items = 0, [(0, 0)]
    for i in order[::-1]:
        left, size, part = min(int(counts[i] - taken[i]), rest // int(lengths[i])), int(lengths[i]), 1
        while left > 0 and by[rest] < 0:
            part = min(part, left)
            step = size * part
            if step <= rest:
                by[step:][(by[:-step] >= 0) & (by[step:] < 0)] = len(items)
                items.append((i, part))
            left -= part
            part *= 2
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, part = items[by[at]]
        taken[i] += part
        at -= int(lengths[i]) * part
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as possible from below.

    Where an attempt misses the budget, the next one leaves the dynamic programme twice the words, up to all of them."""
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    taken, fits = np.zeros(len(counts), np.int64), (lengths <= budget) & (counts > 0)
    if not fits.any():
        return taken
    # sums are multiples of the lengths' common divisor
    unit = int(np.gcd.reduce(lengths[fits]))
    sizes, some, aim, window = lengths[fits] // unit, counts[fits], budget // unit, BUDGET
    if aim >= int((sizes * some).sum()):
        taken[fits] = some
        return taken
    best = _fill(sizes, some, aim, window)
    while int((sizes * best).sum()) < aim and window < aim:
        window *= 2
        found = _fill(sizes, some, aim, window)
        if int((sizes * found).sum()) > int((sizes * best).sum()):
            best = found
    taken[fits] = best
    return taken


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source."""
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(sizes.withColumn("__last", F.col("source").isNull()).repartitionByRange(parts, "__last", "source").withColumn("__part", F.spark_partition_id()), "sources")
    # the position among all sources: rank inside a range partition plus the rows of the partitions before it
    before = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    start, starts = 0, []
    for p in sorted(before):
        starts.append((p, start))
        start += before[p]
    if not starts:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("__part"))
    place = offset + F.row_number().over(Window.partitionBy("__part").orderBy("__last", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = staged(dealt.select("source", "source_size", weight.alias("__w")), "ranked")
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    # with level v (words a unit of weight), a source gets min(v * weight, REPEATS * size): raise v until nothing is above
    budget, level = SHARE * words, 0.0
    while True:
        full = F.col("__w") * F.lit(level) >= REPEATS * F.col("source_size")
        got = ranked.agg(F.sum(F.when(full, REPEATS * F.col("source_size")).otherwise(0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("__w"))).alias("open")).first()
        if not got.open:
            break
        new = (budget - got.capped) / got.open
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("__w") * F.lit(level), (REPEATS * F.col("source_size")).cast("double")).alias("target"))


def _plan(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    size, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    base = int(target // size) if size else 0
    pdf["base"] = np.where(lengths > 0, base, 0)
    pdf["take"] = 0
    if size:
        real = lengths > 0
        pdf.loc[real, "take"] = fit(lengths[real], counts[real], round(target - base * size))
    return pdf[["source", "size", "n", "source_size", "target", "base", "take"]]


def _cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, size, cut, at_cut, alike`` of the lengths of which some documents are taken once more: those with a hash below
    ``cut`` and ``at_cut`` of the ``alike`` ones with that hash. ``sizes`` has ``source, size, code``."""
    counted = sizes.groupBy("source", "size", "code").agg(F.count(F.lit(1)).alias("m")).withColumn("slot", F.shiftright("code", 62 - SLOT_BITS))
    some = plan.where("take > 0").select(F.col("source").alias("of"), F.col("size").alias("length"), "take")

    def crossing(rows: DataFrame, order: str) -> DataFrame:
        """The row of each length in which the running count reaches ``take``; ``below`` is the count before it."""
        before = F.sum("m").over(Window.partitionBy("source", "size").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("below", F.coalesce(before, F.lit(0))).where("below < take AND take <= below + m")

    slots = counted.groupBy("source", "size", "slot").agg(F.sum("m").alias("m"))
    slots = slots.join(some, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))).drop("of", "length")
    hit = crossing(slots, "slot").select(F.col("source").alias("of"), F.col("size").alias("length"), F.col("slot").alias("in_slot"), (F.col("take") - F.col("below")).alias("take"))
    inside = counted.join(hit, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length")) & (F.col("slot") == F.col("in_slot")))
    return crossing(inside.select("source", "size", "code", "m", "take"), "code").select("source", "size", F.col("code").alias("cut"), (F.col("take") - F.col("below")).alias("at_cut"), F.col("m").alias("alike"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken: a multiple of the size). Columns of those
    names in the input are replaced; all others pass through, whatever their names."""
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "taken")
    size, code, book, row = (fresh(docs, n) for n in ("words", "code", "book", "row"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = docs.withColumns({size: n_words(F.col("text")), code: F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.col("text")), 2)})
    with scratch(spark) as outer:
        sizes = staged(sized.select("source", F.col(size).alias("size"), F.col(code).alias("code")), "sizes")
        histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
        aims = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
        aimed = histogram.alias("h").join(aims.alias("a"), F.col("h.source").eqNullSafe(F.col("a.source"))).select("h.source", "h.size", "h.n", "a.source_size", "a.target")
        plan = staged(aimed.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, base long, take long"), "plan")
        cuts = _cuts(sizes, plan).alias("c")
        planned = plan.alias("p").join(cuts, F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size")), "left")
        planned = outer.out(planned.select("p.source", "p.size", "p.source_size", "p.target", "p.base", "c.cut", "c.at_cut", "c.alike"), "book")
    told = planned.select(F.struct("*").alias(book))
    if planned.count() <= BROADCAST_ROWS:  # else the texts are dealt out by source and length
        told = F.broadcast(told)
    joined = sized.join(told, F.col("source").eqNullSafe(F.col(f"{book}.source")) & (F.col(size) == F.col(f"{book}.size")))
    split = (F.col(code) == F.col(f"{book}.cut")) & (F.col(f"{book}.at_cut") < F.col(f"{book}.alike"))

    def result(rows: DataFrame, more: F.Column) -> DataFrame:
        times = F.col(f"{book}.base") + F.coalesce(more.cast("long"), F.lit(0))
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size).alias("size"), F.col(f"{book}.source_size").alias("source_size"), F.col(f"{book}.target").alias("target"), (F.col(size) * times).cast("long").alias("taken"))

    whole = result(joined.where(~F.coalesce(split, F.lit(False))), F.col(code) <= F.col(f"{book}.cut"))
    if planned.where("at_cut < alike").isEmpty():
        return whole
    # equal rows of which only some are taken
    rank = F.row_number().over(Window.partitionBy(f"{book}.source", f"{book}.size").orderBy(code))
    return whole.union(result(joined.where(split).withColumn(row, rank), F.col(row) <= F.col(f"{book}.at_cut")))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    names = [F.col(f"`{c}`") for c in columns]
    return mixed.where(times > 0).select(*names, F.explode(F.sequence(F.lit(1), times)).alias(fresh(mixed, "copy"))).select(*names)
