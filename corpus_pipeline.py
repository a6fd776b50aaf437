"""A training-data pipeline: five stages over `documents`, each written as Parquet and read again as the next one's docs.

Toxic documents go, then all but one of each group of near duplicates, then those that a benchmark contaminates; the rest
are mixed to source weights (rows as often as the mix takes them) and dealt to shards.

Defined cases: null and empty texts are not toxic, form one near-duplicate group with each other and have nothing that the mix
could take; rows with a null doc_id are never a group's kept document but are all kept, as they have no name; an empty table
gives empty stages; all but the last stage return the columns that they were given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, mixing, sharding, simhash, toxicity
from tilewright.llm.common import crc32_of_id, staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score below 0.5 with the model that op2_toxicity learns."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.coalesce(crc32_of_id(F.col("doc_id")) % 5 != 0, F.lit(True)))
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return docs.withColumn("__score", toxicity.scorer(spark, model)("text")).where("__score < 0.5").drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    return simhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that share enough 13-word windows with benchmark items."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix to source weights takes them."""
    return mixing.drawn_copies(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that is left."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned classifier and fingerprints are beyond SQL. Tests hold near duplicates, decontamination and the words that the mix
#: takes against brute force, and the classifier and shards against their properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
