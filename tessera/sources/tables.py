"""Parquet tables, directories of numbered text files, sitemaps and JSON state as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITEMAP_SCHEMA = "url ARRAY<STRUCT<loc STRING, lastmod STRING>>"
PAGE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("crawl_time", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and file_size of the files named <digits>.txt; empty files give no row."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_size")
    named = files.where(F.col("file_name").rlike(r"^[0-9]+\.txt$") & (F.col("value") != ""))
    return named.select(F.regexp_extract("file_name", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("value").alias("text"), F.col("file_size").cast("long"))


def write_text(analyzed: DataFrame, path: str, key: str = "doc_id") -> None:
    """key and the tokens as one text with spaces."""
    analyzed.select(key, F.concat_ws(" ", "tokens").alias("text")).write.mode("overwrite").parquet(path)


def sitemap_entries(sitemaps: DataFrame, body: str = "body", most: int = 0) -> DataFrame:
    """sitemap_url, seq, url, lastmod of the entries that have both, among the first `most` of each sitemap (0: all).
    A body that isn't XML gives no rows."""
    entries = F.from_xml(F.col(body), F.lit(SITEMAP_SCHEMA), {"mode": "PERMISSIVE"})["url"]
    if most:
        entries = F.slice(entries, 1, most)
    rows = sitemaps.select("sitemap_url", F.posexplode(entries).alias("seq", "e"))
    out = rows.select("sitemap_url", "seq", F.trim("e.loc").alias("url"), F.trim("e.lastmod").alias("lastmod"))
    return out.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("lastmod", F.lit("")) != ""))


def save_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state at the path; empty if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
