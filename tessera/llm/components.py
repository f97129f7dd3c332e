"""Connected components of links, and the components of candidates that are grouped in buckets, all in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, release, tasks_for

#: Links that one step of a task holds.
LINKS = 1 << 20
#: Tables of ids up to so many rows are broadcast (under 20 MB); larger ones are joined by shuffle.
BROADCAST = 200_000
HUBS, HUB_ROUNDS = 3, 2
#: Longs in the bit map of a set.
MAP = 8
#: Rows of ids, sizes and bit maps, and elements of sets, up to which a join on the similarity is by broadcast (some 16 MB each).
REACH_ROWS, REACH_ELEMENTS = 100_000, 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links that aren't the least of their component among these links, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        u, v = low[x], low[y]
        least, new = np.minimum(u, v), low.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    below = low != np.arange(len(nodes))
    return nodes[below], nodes[low[below]]


def _forests(links: DataFrame) -> DataFrame:
    """The links of each partition as stars around the least nodes, up to LINKS of them together: the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            found = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n >= LINKS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b), a > b. Each node hands the least of itself and its neighbours to its larger neighbours
    (large) or to itself and its smaller ones (small)."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _whole(links: DataFrame) -> DataFrame:
    """node, component of links that one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)] for batch in batches]
        if held:
            nodes, least = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            top = np.unique(least)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, top])), pa.array(np.concatenate([least, top]))], ["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) of every node of the links (a, b), a written table; loops are left out.

    Up to LINKS of them are settled by one task. More become stars within each partition, before and after they are dealt
    anew. Where a node then has two least nodes, alternating large-star and small-star steps go on, whose number grows with
    the logarithm of the longest path. Each round's links are written to the shared folder.
    """
    links = links.where("a <> b")
    if links.count() <= LINKS:
        return _whole(links)
    links = kept(_forests(_forests(links).distinct()), name)
    while True:
        nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
        nodes = nodes.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
        if nodes.where("component < other").isEmpty():
            return nodes.select("node", "component")
        links = kept(_forests(_star(_star(links.distinct(), True), False)), name)


def small(df: DataFrame) -> DataFrame:
    """df, a written table of ids, marked for broadcast if it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def merged(parts: DataFrame, links: DataFrame, name: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """parts (node, component) after links (a, b) between components, and what changed as (component, new)."""
    stars = kept(components(links, name), f"{name}-moved", tasks)
    moved = stars.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("new"))
    whole = parts.join(small(moved), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = stars.join(small(parts.select("node")), "node", "left_anti")
    return kept(whole.unionByName(alone.select("node", "component")), f"{name}-parts", tasks), moved


def settled(buckets: DataFrame, alike: Callable[[DataFrame], DataFrame], possible: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """node, component of all nodes that are linked to another, where two nodes may be linked if they share a bucket.

    buckets: a written table of distinct (band, node), two nodes or more in each band. alike: the pairs (a, b) of a
    written table that are links. possible: from rows (band, node, component), the pairs of different components in one band that
    may be links.

    No bucket makes all pairs. Each node is compared with the head of one of its buckets, that which it shares most with;
    then with its other heads and with HUBS members of the largest component of each bucket, drawn by hash, where these
    are of another component. What then still lies in one bucket and in several components goes to `possible`.
    """
    tasks = tasks_for(buckets.sparkSession, buckets.count())  # else each step has as many as there are shuffle partitions
    heads = small(kept(buckets.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), f"{name}-heads", tasks))
    pairs = buckets.join(heads, "band").where("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
    pairs = kept(pairs, f"{name}-pairs", tasks)
    best = kept(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), f"{name}-best", tasks)
    parts = kept(components(kept(alike(best), f"{name}-links", tasks), f"{name}-stars"), f"{name}-parts", tasks)
    release(buckets.sparkSession)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(small(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def hubs(rows: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The rows of buckets with several components, and the pairs of their nodes with hubs of another component."""
        draw = lambda k: F.max_by("node", F.xxhash64(F.lit(number * HUBS + k), "node")).alias(f"h{k}")
        per = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), *(draw(k) for k in range(HUBS)))
        top = per.groupBy("band").agg(F.max(F.struct("n", "component", *(f"h{k}" for k in range(HUBS)))).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
        top = small(kept(top.select("band", "top"), f"{name}-tops", tasks))
        several = kept(rows.join(top, "band"), f"{name}-open", tasks)
        star = several.where("component <> top.component").select(F.explode(F.array_distinct(F.array(*(f"top.h{k}" for k in range(HUBS))))).alias("hub"), "node", F.col("top.component").alias("ca"), F.col("component").alias("cb"))
        return several.select("band", "node", "component"), star.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "ca", "cb")

    def more(candidates: DataFrame) -> DataFrame | None:
        """Merges the components (ca, cb) of the candidates (a, b) that are alike; what moved, or None if nothing did."""
        nonlocal parts
        candidates = kept(candidates.distinct(), f"{name}-crossing", tasks)
        if candidates.isEmpty():
            return None
        found = alike(candidates.select("a", "b")).join(small(candidates), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = kept(_forests(found), f"{name}-links", tasks)
        if found.isEmpty():
            return None
        parts, moved = merged(parts, found, f"{name}-stars", tasks)
        return moved

    def moved_on(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
        if moved is None:
            return rows
        return rows.join(small(moved), "component", "left").select("band", "node", F.coalesce("new", "component").alias("component"))

    own = lambda c: small(parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")))
    rest = pairs.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    rest = rest.join(small(best), ["a", "b"], "left_anti")
    rows, star = hubs(placed(buckets.join(heads.where("n > 2").select("band"), "band", "left_semi")), 0)
    rows = moved_on(rows, more(rest.unionByName(star)))
    for number in range(1, HUB_ROUNDS):
        if rows.isEmpty():
            return parts
        release(buckets.sparkSession)
        rows, star = hubs(rows, number)
        rows = moved_on(rows, more(star))
    if rows.isEmpty():
        return parts
    several = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    rows = kept(rows.join(small(kept(several, f"{name}-several", tasks)), "band", "left_semi"), f"{name}-open", tasks)
    if not rows.isEmpty():
        more(possible(rows))
    return parts


def within_reach(rows: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ca, cb) of rows (band, node, component), a written table, in one band and of different components whose
    sets (node, elements, bit map) are alike: a join of each band on the similarity itself.

    Two sets have no more in common than the elements of either that any other set has, so a node with too much to itself
    meets no other; and they differ in as many elements at least as their bit maps do in bits. Only where these bounds allow
    for the threshold are the sets themselves compared, so nothing is lost. Few rows and sets are broadcast, so that a hot
    band is met by all tasks; more are dealt by band, the sets with them.
    """
    n = rows.count()
    tasks = tasks_for(rows.sparkSession, n)
    nodes = small(kept(rows.select("node").distinct(), "open-nodes", tasks))
    own = kept(elements.join(nodes, "node", "left_semi"), "elements", tasks)
    single = own.select(F.explode("elements").alias("unit"), "node").groupBy("unit").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1")
    alone = small(kept(single.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "alone", tasks))
    sizes = own.withColumn("size", F.size("elements")).join(alone, "node", "left")
    sizes = sizes.withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).where(F.col("common") >= F.col("size") * threshold - 1e-6)
    maps = [f"m{k}" for k in range(MAP)]
    few = n <= REACH_ROWS and (own.agg(F.sum(F.size("elements"))).first()[0] or 0) <= REACH_ELEMENTS
    sets = sizes.select("node", "elements")
    carried = ["size", "common", *maps] if few else ["size", "common", *maps, "elements"]
    open_ = rows.join(F.broadcast(sizes.select("node", *carried)) if few else sizes, "node")
    open_ = kept(open_, "open-sizes", tasks) if few else open_
    x, y = (open_.select("band", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "component", *carried))) for side in "ab")
    across = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component"))
    both = F.col("a_size") + F.col("b_size")
    possible = F.least("a_common", "b_common") * (1 + threshold) >= both * threshold - 1e-6
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in maps), F.lit(0))
    possible = possible & (apart * (1 + threshold) <= both * (1 - threshold) + 1e-6)
    shared = F.size(F.array_intersect("a_elements", "b_elements")) * (1 + threshold) >= both * threshold - 1e-6
    if few:
        pairs = x.join(F.broadcast(y), "band").where(across & possible)
        for side in "ab":
            pairs = pairs.join(F.broadcast(sets.select(F.col("node").alias(f"{side}_node"), F.col("elements").alias(f"{side}_elements"))), f"{side}_node")
        pairs = pairs.where(shared)
    else:
        pairs = x.join(y, "band").where(across & F.when(possible, shared).otherwise(False))
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_component").alias("ca"), F.col("b_component").alias("cb"))
