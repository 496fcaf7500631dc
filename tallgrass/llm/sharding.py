"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a document's hash. Depth 0 is one bucket; a bucket that exceeds the byte
limit splits on its next bit, so each bucket has a depth of its own and only oversized ones go deeper.

The directory is found from byte sums of hash prefixes, some bits at a time: prefixes of the current depth are
summed (with map-side partial sums), rolled up to every depth between, and the shallowest prefix that fits ends the
split. Only documents of still oversized prefixes go on, so a pass never touches settled ones. No pass gathers a
bucket's documents: rows meet only as sums.

Defined cases: a null text has 0 bytes; a null id hashes as the text "null"; rows with the same id hash alike, so
copies of one id stay together, and a bucket made of one hash value (or at ``MAX_BITS``) that is still too large is
kept whole and marked ``oversized``; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import fresh, scratch, staged

#: Bits of the hash, from MD5 of the id, that the directory may use.
MAX_BITS = 60
#: Bits that the first pass and each later one refine; a later pass has at most 2**STEP prefixes for each oversized bucket.
FIRST, STEP = 10, 4
#: Production limit of a shard, in bytes of UTF-8 text.
SHARD_BYTES = 1 << 20


def hash_bits(doc_id) -> F.Column:
    """``MAX_BITS`` bits of MD5 of the id's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, MAX_BITS // 4), 16, 10).cast("long")


def prefix(bits, depth) -> F.Column:
    """The leading ``depth`` bits, as a long."""
    return F.expr(f"shiftright({bits}, cast({MAX_BITS} - ({depth}) as int))")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``(depth, slot, shard_bytes, oversized)``: one row per bucket. ``sizes`` has ``bits`` and ``size``."""
    sums = staged(sizes.groupBy("bits").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), "sizes")
    found, base = None, 0
    rest = sums
    while True:
        top = min(MAX_BITS, base + (STEP if base else FIRST))
        fine = rest.groupBy(prefix("bits", top).alias("fine")).agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"), F.min("bits").alias("lo"), F.max("bits").alias("hi"))
        levels = fine.select(F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))).alias("depth"), "size", "docs", "lo", "hi").withColumn("slot", F.expr(f"shiftright(lo, cast({MAX_BITS} - depth as int))"))
        tree = staged(levels.groupBy("depth", "slot").agg(F.sum("size").alias("shard_bytes"), F.sum("docs").alias("n_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "tree")
        done = (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == MAX_BITS)
        # a bucket is a leaf if it is done and its parent is not; the parents of this pass's first level are oversized
        split = tree.where(~done).select((F.col("depth") + 1).alias("pd"), F.col("slot").alias("ps"))
        start = F.col("depth") == (base + 1 if base else 0)
        below = tree.where(done & ~start).join(split, (F.col("depth") == F.col("pd")) & (F.expr("shiftright(slot, 1)") == F.col("ps")), "left_semi")
        leaves = staged(tree.where(done & start).unionByName(below).select(F.col("depth"), "slot", "shard_bytes", "n_docs").withColumn("oversized", F.col("shard_bytes") > limit), "leaves")
        found = leaves if found is None else found.unionByName(leaves)
        if top == MAX_BITS:
            return found
        over = tree.where((F.col("depth") == top) & ~done).select(F.col("slot").alias("over"))
        rest = staged(rest.join(over, prefix("bits", top) == F.col("over"), "left_semi"), "over")
        if rest.isEmpty():
            return found
        base = top


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (the directory's bit string, "" for a single bucket), ``shard_depth``, ``shard_bytes``,
    ``doc_bytes`` and ``oversized``. Columns of those names in the input are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "shard_depth", "shard_bytes", "doc_bytes", "oversized")
    bits, size, book = (fresh(docs, n) for n in ("bits", "size", "book"))
    sized = docs.withColumns({bits: hash_bits(F.col("doc_id")), size: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    slim = sized.select(F.col(bits).alias("bits"), F.col(size).alias("size"))
    with scratch(spark) as outer:
        leaves = staged(directory(slim, limit).select("depth", "slot", "shard_bytes", "oversized"), "directory")
        depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # at most MAX_BITS + 1 numbers
        # every document has one ancestor that is a leaf: try the depths in use as (depth, prefix) keys
        keys = F.array(*[F.struct(F.lit(d).cast("int").alias("depth"), prefix("bits", d).alias("slot")) for d in depths]) if depths else F.array().cast("array<struct<depth:int,slot:bigint>>")
        slots = outer.out(slim.select("bits").distinct().select("bits", F.inline(keys)).join(leaves, ["depth", "slot"]), "slots")
    out = sized.join(slots.select(F.struct("*").alias(book)), F.col(bits) == F.col(f"{book}.bits"))
    depth = F.col(f"{book}.depth")
    text = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(f"{book}.slot").cast("string"), 10, 2), depth, F.lit("0")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], text.alias("shard"), depth.cast("long").alias("shard_depth"), F.col(f"{book}.shard_bytes").alias("shard_bytes"), F.col(size).alias("doc_bytes"), F.col(f"{book}.oversized").alias("oversized"))
