"""Documents to training shards: STAGES, each written as Parquet and read again as the next one's input.

1. quality_rules: documents that the base rules or the isolation forest reject go.
2. near_dedup: of documents linked by SimHash fingerprints one stays.
3. decontaminate: documents that overlap a benchmark item go.
4. mix: documents are taken as often, and as far, as their sources' quotas say.
5. shard: each row gets a shard and a slot in it.

All stages but the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tupelo.llm import decontaminate, mixing, quality_rules, sharding, simhash
from tupelo.llm._common import discard, fresh_path, saved, scratch

SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: SQL can express neither the forest nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the stages' tables only the one being read and the one being written
    exist, and what a stage has written besides goes with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark, whole=True):
            docs = saved(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(spark, before)
        before = path
    return docs
