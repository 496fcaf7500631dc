"""Logical inputs of the operators, taken from the test tables by analogy. Each Spark frame has its SQL twin in ``CTES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import text as T

NOW = 1_800_000_000
KINDS = ("guardrail", "user", "convention", "feedback", "decision", "error_pattern", "reference", "project")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    original = F.round(F.col("value") * 10).cast("long")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("layer"), F.when(k % 2 == 0, "even").otherwise("odd").alias("feature"), F.col("user_id").alias("session"), original.alias("original_tokens"), F.floor(original * (k % 10) / 10).cast("long").alias("compressed_tokens"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    tool = F.when(F.col("role") == "user", "Read").when(F.col("role") == "assistant", "Bash").otherwise("Grep")
    estimate = T.token_estimate(F.col("text"))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", tool.alias("tool"), F.split("text", " ")[0].alias("target"), F.when(F.col("turn") % 5 == 4, "err").otherwise("ok").alias("status"),
        estimate.alias("original_tokens"), F.floor(estimate / 2).cast("long").alias("compressed_tokens"), F.when(F.col("turn") < 2, F.col("conv_id")).alias("rolled_up_into"), "text")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "user", "user").otherwise("tool").alias("stream"), "text")


def files(spark: SparkSession, d: str, which: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text", "doc_id")
    if which == "stored":
        return docs.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return docs.where("doc_id % 11 <> 0").select("path", F.col("text").alias("content"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    both = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return both.select(F.col("doc_id").alias("id"), kind.alias("kind"), (F.col("doc_id") % 10 + 1).cast("long").alias("importance"), F.lit(1.0).alias("relevance"), (F.lit(NOW) - F.col("doc_id") * 3600).alias("last_seen"), (F.col("quality") == 0).alias("archived"), F.col("text").alias("content"), F.col("source").alias("project"), F.substring("text", 1, 40).alias("title"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    q = lambda kind, key: F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))
    parts = [table(spark, d, t).select(q(t, k).alias("qn"), F.col(n).cast("string").alias("name"), F.lit(t).alias("file"), F.col(k).cast("long").alias("line")) for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(spark: SparkSession, d: str) -> DataFrame:
    def e(t, a, to, b):
        return table(spark, d, t).select(F.concat(F.lit(f"{t}::"), F.col(a).cast("string")).alias("source"), F.concat(F.lit(f"{to}::"), F.col(b).cast("string")).alias("target"), F.lit(0.6).alias("confidence"))
    return e("nation", "n_nationkey", "region", "n_regionkey").unionByName(e("supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(e("customer", "c_custkey", "nation", "c_nationkey"))


def bare_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nations named by bare name only, and links of pages that no node has."""
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("source"), F.col("n_name").alias("target"), F.lit(0.6).alias("confidence"))
    links = table(spark, d, "pages").select(F.concat(F.lit("page::"), F.col("page_id").cast("string")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"), F.lit(0.5).alias("confidence"))
    return edges(spark, d).unionByName(named).unionByName(links)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 100).cast("double").alias("mtime"), F.round(F.col("value") * 200).cast("long").alias("size"), (F.col("event_type") == "signup").alias("blocked"))


def query_text(spark: SparkSession, d: str) -> str:
    return table(spark, d, "benchmark").where("item_id = 0").select("text").first()[0]


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


CTES = {
    "telemetry": "SELECT event_id, event_type AS layer, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS feature, user_id AS session, o AS original_tokens, CAST(floor(o * (k % 10) / 10) AS BIGINT) AS compressed_tokens FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 10) AS BIGINT) AS o FROM events)",
    "turns": "SELECT conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'Read' WHEN 'assistant' THEN 'Bash' ELSE 'Grep' END AS tool, string_split(text, ' ')[1] AS target, CASE WHEN turn % 5 = 4 THEN 'err' ELSE 'ok' END AS status, CAST(ceil(length(text) / 4) AS BIGINT) AS original_tokens, CAST(floor(ceil(length(text) / 4) / 2) AS BIGINT) AS compressed_tokens, CASE WHEN turn < 2 THEN conv_id END AS rolled_up_into, text FROM conversations",
    "stored": "SELECT concat(source, '/', doc_id) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "present": "SELECT concat(source, '/', doc_id) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0",
    "observations": f"SELECT l.doc_id AS id, {list(KINDS)}[l.doc_id % 8 + 1] AS kind, CAST(l.doc_id % 10 + 1 AS BIGINT) AS importance, 1.0::DOUBLE AS relevance, {NOW} - l.doc_id * 3600 AS last_seen, quality = 0 AS archived, d.text AS content, d.source AS project FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id",
    "nodes": " UNION ALL ".join(f"SELECT concat('{t}::', {k}) AS qn, {n} AS name, '{t}' AS file, CAST({k} AS BIGINT) AS line FROM {t}" for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))),
    "edges": " UNION ALL ".join(f"SELECT concat('{t}::', {a}) AS source, concat('{o}::', {b}) AS target, 0.6::DOUBLE AS confidence FROM {t}" for t, a, o, b in (("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "c_custkey", "nation", "c_nationkey"))),
}
CTES["bare_edges"] = "SELECT * FROM edges UNION ALL SELECT concat('customer::', c_custkey), n_name, 0.6 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT concat('page::', page_id), unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), 0.5 FROM pages"
