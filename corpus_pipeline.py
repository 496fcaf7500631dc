"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; its result is written as
Parquet and read again as the next stage's ``docs``; ``run`` deletes a table once the next one is written.

Defined cases of every stage: columns beside ``doc_id``, ``text``, ``lang`` and ``source`` pass through, whatever their names
(sharding adds its own and replaces columns of those names); an empty table gives an empty one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import common, decontaminate, langid, mixing, sharding, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unknown or too uncertain language go.

    Null, empty and letterless texts are of unknown language and go. Repeated rows fare alike. Null ids or labels are not
    learned from; the documents are judged like any other. Equal scores go to the first language in order."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id.

    Null and empty texts are one group. Of equal rows one stays, whichever; of several rows with the least id the one of
    the least text hash. Unlike texts of one id are documents of their own. Rows without id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item within its edit budget go.

    Null and empty texts contain nothing and stay; null items are none. Repeated rows fare alike; ids play no part."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it (0 to 2 times).

    Documents without words (null and empty texts) are never taken. A null source is one source. Of repeated rows any may
    be the one taken; ties of the seeded hash are such rows only."""
    return mixing.expand(mixing.mix(docs), docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard.

    A null text has 0 bytes. Rows of one id (null is one too) stay together, so a shard of one id alone may exceed the
    limit and is marked then."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Language ID, SimHash and the mix's subset sums are not expressible in SQL; a small fixture is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES[:-1]:
        docs, path = common.restaged(stage(spark, docs, sf_dir), path, name)
    return STAGES[-1][1](spark, docs, sf_dir)
