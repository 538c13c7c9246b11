"""A corpus in five stages: known languages, one document of near copies, no benchmark leaks, mixed sources, shards.

Each stage works on all that its predecessor kept. run() writes what a stage returns as Parquet to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, langid, mixing, sharding, simhash
from sparkloom.llm.common import crc32_mod, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which no language can be told: those without a letter, and those that are like none of the
    profiles (as in op10) though they have trigrams enough to tell."""
    profiles = langid.fit_profiles(docs.where(crc32_mod("doc_id", 5) != 0))
    return langid.identify(docs, profiles, keep=langid.KEEP).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, 0 to 3 times."""
    return mixing.repeat_taken(mixing.mix(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With shard (0 to 15, near equal bytes) and slot."""
    return sharding.histogram_sort_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Trigram vectors, XXH64, a sketch's basis and a dynamic programme have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
