"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

Each shard draws a number from the hash of (key, shard); the shard whose weighted draw is highest takes the record. The
key and the list of shards alone decide, so no shuffle is needed to place a record, and a shard that joins takes records
only into itself, one that leaves gives up only its own.

Defined results: a null key hashes as the text `null`, so all null keys share a shard; repeated rows share a shard and get
different slots; an empty table gives an empty result; input columns of any name are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import draw, free_name, unit

#: Runs of slots that are numbered apart in each shard, so no task holds a whole shard.
BUCKETS = 1024


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The weighted draw of one shard: -ln(u) / weight is exponential, and the lowest wins."""
    return -F.ln(unit("shard", key, str(shard))) / F.lit(float(weight))


def place(key: Column, weights: Sequence[float]) -> Column:
    """The shard, counted from 0, that takes the key; a tie goes to the lower shard, a weight of 0 takes nothing."""
    live = [F.struct(score(key, j, w).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*live))["j"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row in column `out`; a narrow projection."""
    return df.withColumn(free_name(df, out), place(F.col(key), weights))


def bucket(key: Column) -> Column:
    """The run of slots of a key: an even split of a shard that the key alone decides."""
    return (draw("slot", key) % BUCKETS).cast("int")


def number_slots(df: DataFrame, key: str, shard: str, columns: Sequence[str], slot: str = "slot") -> DataFrame:
    """The rows' `columns` with a slot: in each shard 0, 1, 2, ... in the order of bucket and `columns`.

    Rows are numbered within (shard, bucket), and each bucket starts where the counts of those before it end. Equal rows
    are counted before the shuffle, so a row repeated any number of times moves once per task.
    """
    n, b, first = "__n", "__bucket", "__first"
    counted = df.groupBy(*dict.fromkeys([*columns, key, shard])).agg(F.count(F.lit(1)).alias(n)).withColumn(b, bucket(F.col(key)))
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.select(shard, bucket(F.col(key)).alias(b)).groupBy(shard, b).agg(F.count(F.lit(1)).alias(n))
    starts = sums.select(shard, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))  # shards x BUCKETS rows at most
    inside = Window.partitionBy(shard, b).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), [shard, b])
    return joined.select(*columns, F.explode(F.sequence(F.col(first) + F.col("__before"), F.col(first) + F.col("__before") + F.col(n) - 1)).alias(slot))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Writes the rows below `path` in a folder for each shard, `shard=0` and so on."""
    name = free_name(df, "shard")
    assign_shards(df, key, weights).write.partitionBy(name).parquet(path)
