"""From raw documents to shards of a training mix: five stages over the whole table.

Each stage takes what its predecessor kept and returns documents with all their columns;
the last returns where each document goes. Stages are written to the shared folder and
read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmirror.llm import decontaminate, language, mixing, sharding, simhash
from inkmirror.session import configure, cut

SHARDS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those in none, or switched throughout, go."""
    configure(spark)
    return language.keep_known(docs, language.fit(docs, F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as the SimHash operator finds them."""
    configure(spark)
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.DISTANCE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    configure(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    configure(spark)
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of each document."""
    configure(spark)
    return sharding.shard(docs, leaves=SHARDS)


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

# A trained model and a random rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
