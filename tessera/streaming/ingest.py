"""Continuous ingestion: pages that land in a folder are upserted by url into a versioned store, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.crawl import upsert
from tessera.operators.index import merge_postings, posting_blocks, postings
from tessera.sources.tables import PAGE_SCHEMA

LANDING = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("crawl_time", T.DoubleType())])


def _versions(spark: SparkSession, store: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def read_store(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The latest complete version of the store, or the latest before a batch; empty if there is none."""
    found = [v for v in _versions(spark, store) if before is None or v < before]
    return spark.read.schema(PAGE_SCHEMA).parquet(f"{store}/version={found[-1]}") if found else spark.createDataFrame([], PAGE_SCHEMA)


def ingest(landing: DataFrame, store: str, checkpoint: str):
    """Starts the query on a streaming DataFrame of LANDING rows and handles what is there. Batch n writes version n from
    the version before it, so a batch that runs again writes the same version again."""

    def apply(batch: DataFrame, number: int) -> None:
        upsert(read_store(batch.sparkSession, store, number), batch).write.mode("overwrite").parquet(f"{store}/version={number}")

    return landing.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge_index(index: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The posting blocks after the documents came in: their old postings go, their new ones come."""
    ids = docs.select(F.col(key).alias("__id")).distinct()
    old = index.select("term", "block", F.explode("postings").alias("__id")).join(ids, "__id", "left_anti")
    old = old.groupBy("term", "block").agg(F.collect_list("__id").alias("postings"))
    new = posting_blocks(postings(docs, key, text), key).select("term", "block", "postings")
    both = old.unionByName(new).groupBy("term", "block").agg(merge_postings(F.collect_list("postings")).alias("postings"))
    df = both.groupBy("term").agg(F.sum(F.size("postings")).cast("long").alias("df"))
    return both.join(df, "term").select("term", "block", "df", "postings")
