"""Mixing of sources to target weights.

Tokens are summed per source, a repetition rate follows for each source, and a document is emitted floor(rate) times plus
once more if its seeded hash falls below the fraction of the rate.

Defined results: a null source is a source of its own and comes last; a null or empty text has size 0; a source without
tokens has target and rate 0; repeated rows draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, unit

WEIGHTS, MOST = (5, 2, 1), 3
#: Per-source tables up to so many rows are broadcast (under 50 MB); larger ones are joined by shuffle.
BROADCAST_SOURCES = 200_000


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: source, source_size, weight, target, rate.

    Targets share the sum of all sizes by weight. A target stops at `most` times its source's size and the others share
    the excess by weight, which levels all at min(most * size, level * weight). Sources in order of size per weight reach
    their stop one after another, so the level follows from running sums over the per-source rows.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    everything, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("__level", rest / share)
    free = F.col("source_size") * most > F.col("__level") * F.col("weight")
    per = per.withColumn("__top", F.max(F.when(free, F.col("__level"))).over(everything))
    target = F.least(F.col("source_size") * most, F.coalesce(F.col("__top") * F.col("weight"), F.col("source_size") * most)).cast("double")
    per = per.select("source", "source_size", "weight", target.alias("target"))
    return per.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))


def copies(key: Column, rate: Column, seed: str) -> Column:
    """floor(rate), and one more with a probability of the rest, decided by the key."""
    return (F.floor(rate) + F.when(unit(seed, key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def with_copies(df: DataFrame, key: str, source: str, targets: DataFrame, seed: str = "mix", out: str = "copies") -> DataFrame:
    """df with how often each row is emitted, and its source's source_size and target beside it.

    The per-source rows are counted first; few are broadcast, many go through a shuffle join whose hot keys Spark splits.
    """
    names = {c: free_name(df, c) for c in ("__source", "source_size", "target", "__rate", out)}
    small = targets.select(F.col("source").alias(names["__source"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), F.col("rate").alias(names["__rate"]))
    if targets.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    joined = df.join(small, df[source].eqNullSafe(small[names["__source"]])).drop(names["__source"])
    return joined.withColumn(names[out], copies(F.col(key), F.col(names["__rate"]), seed)).drop(names["__rate"])


def mix(df: DataFrame, key: str, source: str, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """df's rows, each as often as the mix takes it, with df's columns."""
    n = free_name(df, "copies")
    drawn = with_copies(df, key, source, targets, seed, n).where(F.col(n) > 0)
    copy = free_name(drawn, "__copy")
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)
