"""From documents to shards of a training mix: each stage takes what the one before kept.

1. toxicity: documents that score toxicity.THRESHOLD or more go.
2. near_dedup: one document of each class of near duplicates stays, that of the least id.
3. decontaminate: documents that leak a benchmark item go.
4. mix: sources come to their target weights; a document is repeated or left out as its source's rate and its hash say.
5. shard: each document gets a shard by rendezvous hashing of its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import darts, decontaminate, mixing, sharding, toxicity
from tessera.llm.common import kept, read, words

SHARDS = 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return darts.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table = decontaminate.hashed(docs, "doc_id", "text")
    return decontaminate.keep_clean(docs, decontaminate.build(spark, table, read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sizes = docs.select("source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mixing.mix(docs, "doc_id", "source", kept(mixing.source_targets(sizes, "source", "size"), "targets"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The toxicity network, verified near duplicates and latent retrieval have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
