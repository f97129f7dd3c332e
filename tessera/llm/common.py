"""What the operators of this subpackage share: words, hashes, samples and shared storage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch_path

#: A word of the contracts is a run of anything but these six characters.
GAP = r"[\x20\x09-\x0D]+"
#: Rows of ids that a task is worth.
TASK_ROWS = 25_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def draw(*parts: Column | str) -> Column:
    """A long in [0, 2**52) that the parts alone decide: the first 13 hex digits of their md5."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def unit(*parts: Column | str) -> Column:
    """`draw` as a double strictly between 0 and 1."""
    return (draw(*parts).cast("double") + 0.5) / float(1 << 52)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, lengthened until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows of ids are worth: two a core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def kept(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing.
    tasks: how many write it at most, however many partitions it was shuffled to.

    The files stay until `scratch.sweep`, as the result is lazy and may be read at any later time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if tasks is None else df.coalesce(tasks)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, whereupon Spark deletes the shuffle files of stages that are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of lowest seeded hash of the key: the same rows on every run. Only rows below a hash that about n rows
    and a margin pass are sorted, so that tasks send few rows however many tasks there are."""
    total, order = df.count(), F.xxhash64(F.lit(seed), F.col(key))
    if total > n:
        df = df.where(order <= int(-(1 << 63) + min(1.0, (n + 8 * n**0.5 + 64) / total) * ((1 << 64) - 1025)))
    return df.orderBy(order, F.col(key)).limit(n)


def among(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in `chosen`, a sample whose documented bound allows a broadcast."""
    return df.join(F.broadcast(chosen.select(key).distinct()), key, "left_semi")
