"""The corpus pipeline: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of ``documents``; the last one places each row in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readforge.llm import decontaminate, mixing, quality, sharding, simhash, similar
from readforge.llm.common import materialize, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What operator 4's fingerprints link and is as similar, and what is as similar with fingerprints further apart."""
    return simhash.keep_first(docs, groups=similar.groups(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: The fitted quality model, 64-bit XXH64 and edit distances have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
