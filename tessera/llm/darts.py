"""DartMinHash signatures of weighted sets, and near-duplicate classes of documents by banding them.

A document is the multiset of its five-word shingles. Darts fall on each element as a Poisson process over weight and
rank: the unit slab of weight number u of element i gets darts at ranks that are running sums of exponential draws hashed
from (i, u, number of the dart). A document of total weight W looks at the darts that fall within its elements' weights
below rank t / W, about t darts however many elements it has, and each of K coordinates keeps the earliest dart that is
hashed to it; where a coordinate is left empty, the rank is doubled. Two documents share a coordinate's dart with a
probability of their weighted Jaccard similarity.

Signatures are cut into bands. Documents that share a band are candidates; `components.settled` compares them so that no
link between components is lost among candidates while a large group of copies makes few pairs. Pairs are verified by
exact weighted Jaccard of the shingles' 64-bit hashes.

Defined results: a text of one to four words is one shingle; texts without words are copies of one another; a null text
is a class of its own with every other null text's row apart; equal words make equal texts, however long they are; rows
with a null key take part and have the class of the least key that isn't null; extra columns of any name are left as they
are; an empty table gives an empty result. Distinct texts are told apart by 64 hash bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import bounded
from tessera.llm.common import free_name, kept, release, tasks_for
from tessera.llm.components import MAP, settled, small, within_reach
from tessera.llm.hashing import mixed, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 20 bands of 5 find a pair of similarity 0.8 with a probability of 0.9996.
BANDS, ROWS = 20, 5
#: Texts that a task remembers so as not to sign their copies again.
SEEN = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def units(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words, one after another: a hash for each unit of weight of their shingles, sorted but for
    repeats within each text, and how many units each text has. A unit's hash is of the shingle and the number of its
    repeats before."""
    first = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    start = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(first - start, counts)
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    sums = padded[: len(words)] * _ODD[0]
    for k in range(1, SHINGLE):
        sums += padded[k : len(words) + k] * _ODD[k]
    out = mixed(sums[at])
    for k in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        out[start[k]] = mixed((words[first[k] : first[k] + sizes[k]] * _ODD[: sizes[k]]).sum(keepdims=True, dtype=np.uint64))[0]
    for a, n in zip(start.tolist(), counts.tolist(), strict=True):
        out[a : a + n].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[counts > 0]] = True
    if not new.all():
        places = np.arange(len(out))
        repeat = places - np.maximum.accumulate(np.where(new, places, 0))
        out = np.where(repeat > 0, mixed(out + repeat.astype(np.uint64) * _ODD[1]), out)
    return out, counts


def signatures(units: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates of each text, as 40 bits of rank above 24 bits of the dart's hash."""
    none = np.iinfo(np.uint64).max
    out = np.full((len(counts), k), none, np.uint64)
    rank = (k * np.log(k) + 2 * k) / np.maximum(counts, 1)
    text = np.repeat(np.arange(len(counts)), counts)
    while len(units):
        best = out.reshape(-1)
        at, live, of, number = np.zeros(len(units)), units, text, 0
        while len(live):
            dart = mixed(live + np.uint64(number * int(_ODD[2]) % 2**64))
            at = at - np.log(((dart >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
            inside = at < rank[of]
            at, live, of, dart = at[inside], live[inside], of[inside], dart[inside]
            spot = mixed(dart ^ _ODD[3])
            # Ranks compare as the bits of 1 + rank / 2**12, in [1, 2), do; 40 of the 52 bits of the fraction are kept.
            bits = ((1 + at * 2.0**-12).view(np.uint64) << np.uint64(12)) & np.uint64(0xFFFFFFFFFF000000)
            np.minimum.at(best, of * k + (spot % np.uint64(k)).astype(np.int64), bits | (spot >> np.uint64(40)))
            number += 1
        gaps = (out.max(axis=1) == none) & (counts > 0)  # ranks double for them until there is none
        rank = rank * 2
        some = gaps[text]
        units, text = units[some], text[some]
        out[gaps] = none
    return out


def band_keys(signs: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each text and band, the band's number included."""
    cut = signs.reshape(len(signs), bands, signs.shape[1] // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[4], cut.shape[:2])
    for k in range(cut.shape[2]):
        out = mixed(out ^ cut[:, :, k])
    return out.view(np.int64)


def nodes(words: np.ndarray, sizes: np.ndarray) -> list[int]:
    """A hash of the words of each text, in their order."""
    ends = np.cumsum(sizes)
    data = words.tobytes()
    return [xxhash.xxh64_intdigest(data[8 * a : 8 * b]) - (1 << 63) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of unit hashes, whose members differ by construction."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def signed(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, node (hash of the words; null for a null text), size (shingles) and the band keys of each document. A copy of
    a text that its task has signed has no band keys."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches, "__text"):
            texts = batch.column(1).to_pylist()
            words, sizes, _ = word_hashes(texts)
            found = nodes(words, sizes)
            fresh = np.zeros(len(texts), bool)
            for i, (x, n) in enumerate(zip(found, sizes.tolist(), strict=True)):
                if n and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            its, counts = units(words[np.repeat(fresh, sizes)], sizes[fresh])
            size = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
            keys = iter(band_keys(signatures(its, counts, bands * rows), bands))
            column = pa.array([next(keys) if f else None for f in fresh.tolist()], pa.list_(pa.int64()))
            node = pa.array([None if t is None else x for t, x in zip(texts, found, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(size), column], [key, "node", "size", "bands"])

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, node long, size long, bands array<bigint>")


def _units(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """node and its unit hashes, as bytes, for the nodes of `places` (node, id), once each. A null id names no row, so its
    nodes are looked for in all rows without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            words, sizes, _ = word_hashes(batch.column(1).to_pylist())
            want = batch.column(0).to_pylist()
            found = nodes(words, sizes)
            same = np.array([w is None or w == f for w, f in zip(want, found, strict=True)], bool)  # a row of the same id may have another text
            its, counts = units(words[np.repeat(same, sizes)], sizes[same])
            ends = np.cumsum(counts)
            sets = [its[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, s in zip(found, same.tolist(), strict=True) if s], pa.int64()), pa.array(sets, pa.binary())], ["node", "units"])

    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    some = small(places.where("id is not null"))
    known = rows.join(some, rows["__id"] == some["id"]).select("node", "__text").mapInArrow(run, "node long, units binary")
    other = rows.where("__id is null").select(F.lit(None).cast("long").alias("node"), "__text").mapInArrow(run, "node long, units binary")
    other = other.join(places.where("id is null").select("node"), "node", "left_semi")
    return known.unionByName(other).groupBy("node").agg(F.first("units").alias("units"))


def verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a written table, whose exact similarity reaches the threshold."""
    left = units.select(F.col("node").alias("a"), F.col("units").alias("ua")).join(small(pairs), "a")
    both = left.join(units.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b").select("a", "b", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "ua"):
            ua, ub = (batch.column(k).to_pylist() for k in (2, 3))
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(ua, ub, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def elements(units: DataFrame, column: str = "units") -> DataFrame:
    """node, its hashes as an array, and a map of them in MAP longs: a bit for each value of a hash's first bits."""
    names = [f"m{k}" for k in range(MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, column):
            found = [np.frombuffer(u, np.uint64) for u in batch.column(1).to_pylist()]
            bits = np.zeros((len(found), 64 * MAP), bool)
            for row, x in zip(bits, found, strict=True):
                row[x % np.uint64(64 * MAP)] = True
            maps = np.packbits(bits, axis=1).view(np.int64)
            arrays = [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["node", "elements", *names])

    return units.select("node", column).mapInArrow(run, f"node long, elements array<bigint>, {', '.join(f'{n} long' for n in names)}")


def node_classes(table: DataFrame, docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """node, component of all nodes that are linked to another. table: what `signed` made, written."""
    rows = table.where("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    tasks = tasks_for(docs.sparkSession, table.count())
    shared = small(kept(shared, "shared", tasks))
    buckets = kept(rows.join(shared, "band", "left_semi").distinct(), "buckets", tasks)  # of two nodes or more
    nodes = small(kept(buckets.select("node").distinct(), "bucket-nodes", tasks))
    places = table.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(key).alias("id"))
    units = kept(_units(docs, key, text, kept(places, "places", tasks)), "units", tasks)
    release(docs.sparkSession)
    alike = lambda pairs: verified(pairs, units, threshold)
    return settled(buckets, alike, lambda open_: within_reach(open_, elements(units), threshold), "near")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: key, node and class_id, the least key of its class; a null text's class is its own key."""
    release(docs.sparkSession)  # of what ran before, as the jobs to come are many
    table = kept(signed(docs, key, text), "signed")
    tasks = tasks_for(docs.sparkSession, table.count())
    parts = node_classes(table, docs, key, text, threshold)
    own = table.where("node is not null").groupBy("node").agg(F.min(key).alias("least"))
    placed = kept(own.join(small(parts), "node", "left").select("node", "least", F.coalesce("component", "node").alias("__part")), "placed", tasks)
    least = placed.groupBy("__part").agg(F.min("least").alias("class_id"))
    of = small(kept(placed.join(least, "__part").select(F.col("node").alias("__node"), "class_id"), "node-classes", tasks))
    rows = table.select(key, "node").join(of, F.col("node") == F.col("__node"), "left")
    return rows.select(key, "node", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"))


def with_nodes(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs and the hash of each text's words in a column of that name."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*docs.schema.fields]).add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = nodes(*word_hashes(texts)[:2])
            column = pa.array([None if t is None else x for t, x in zip(texts, found, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least key; columns as they were. Rows with a null key all stay.

    Keys that occur more than once are rare and are settled apart by key and text, so that no other text is shuffled.
    """
    found = kept(classes(docs, key, text, threshold), "classes")
    other, name, node = (free_name(docs, n) for n in ("__key", "__node", "__other"))
    twice = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = small(kept(twice.select(F.col(key).alias(other)), "twice"))
    go = kept(found.where(F.col(key) != F.col("class_id")).select(F.col(key).alias(other), F.col("node").alias(node)).distinct(), "copies")
    rows = docs.join(small(go), docs[key] == F.col(other), "left_anti")
    if twice.isEmpty():
        return rows
    rows = rows.join(twice, rows[key] == F.col(other), "left_anti")
    again = with_nodes(docs.join(twice, docs[key] == F.col(other), "left_semi"), text, name).dropDuplicates([key, name])
    again = again.join(small(go), (again[key] == F.col(other)) & again[name].eqNullSafe(F.col(node)), "left_anti")
    return rows.unionByName(again.drop(name))
