"""The registered queries ``opN_<name>`` of this subpackage, and their SQL where it exists.

Each reads its whole tables and derives the contract's columns from an operator's general output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import decontaminate, langid, mixing, quality, secrets, sharding, simhash, substrings, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "doc_bytes", "shard", "shard_depth", "shard_bytes", "oversized")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id", "n_links")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_secret_scan, op4_decontamination, op5_suffix_array_dedup, op6_url_filter, op7_quality_rules, op8_sharding, op9_simhash, op10_mixing)}


OP2_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT row_id, doc_id, i, list_slice(words, i, i + 12) AS run FROM (SELECT row_id, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
firsts AS (SELECT run, min(doc_id) AS first_id FROM w GROUP BY run),
dup AS (SELECT w.row_id, w.i FROM w JOIN firsts USING (run) WHERE first_id < w.doc_id),
gone AS (SELECT DISTINCT row_id, i + k AS i FROM dup, range(0, 13) AS r(k)),
cut AS (SELECT row_id, list(i ORDER BY i) AS gone FROM gone GROUP BY row_id),
full_words AS (SELECT row_id, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT f.row_id, string_agg(f.words[f.i], ' ' ORDER BY f.i) AS text FROM full_words AS f LEFT JOIN gone AS g ON f.row_id = g.row_id AND f.i = g.i WHERE g.i IS NULL GROUP BY f.row_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (row_id) LEFT JOIN kept USING (row_id)
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS doc_bytes, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS bits FROM documents),
t AS (SELECT depth, bits >> ({sharding.MAX_BITS} - depth) AS slot, sum(doc_bytes) AS shard_bytes, min(bits) AS lo, max(bits) AS hi FROM d, range(0, {sharding.MAX_BITS} + 1) AS r(depth) GROUP BY ALL),
leaf AS (SELECT * FROM t WHERE shard_bytes <= {sharding.SHARD_BYTES} OR lo = hi OR depth = {sharding.MAX_BITS}),
best AS (SELECT d.bits, min(depth) AS depth FROM (SELECT DISTINCT bits FROM d) AS d JOIN leaf ON leaf.slot = d.bits >> ({sharding.MAX_BITS} - leaf.depth) GROUP BY d.bits)
SELECT d.doc_id, CAST(d.doc_bytes AS BIGINT) AS doc_bytes, CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(l.slot), CAST(b.depth AS INTEGER), '0') END AS shard, CAST(b.depth AS BIGINT) AS shard_depth, CAST(l.shard_bytes AS BIGINT) AS shard_bytes, l.shard_bytes > {sharding.SHARD_BYTES} AS oversized
FROM d JOIN best AS b USING (bits) JOIN leaf AS l ON l.depth = b.depth AND l.slot = d.bits >> ({sharding.MAX_BITS} - b.depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_secret_scan": secrets.duckdb_sql(), "op6_url_filter": urls.duckdb_sql(), "op8_sharding": OP8_SQL}
