"""Benchmark decontamination by latent semantic retrieval.

Texts become 32-bit hashes of their words once. Passages of PASSAGE words, one every STRIDE words, and the benchmark items
are TF-IDF vectors over BUCKETS of hashes; document frequencies come from all documents. A randomised SVD, whose products
run on the executors over all passages of all documents and items, gives RANK right singular vectors; scaled to equal
variance they are the latent space. Every passage is projected and compared with every item, in blocks, by cosine. For
candidates, the longest common subsequence of the item's content words (those in at most COMMON of the documents) and of
the words around the passage decides: LIKE of the item or more is a leak, PARAPHRASE or more is one if the item's answer
(its last sentence, of MIN_ANSWER words at least) is there in order too.

Defined results: items of MIN_EXACT to MIN_WORDS - 1 words leak where they occur word for word, shorter ones and null items
match nothing; an item with under MIN_CONTENT content words is compared by all its words and leaks at ALL_LIKE; null and
empty texts have no passages and are clean; very long texts are searched whole; equal items are told apart by id; repeated
rows get equal answers; extra columns of any name are left as they are; an empty benchmark leaks nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import bounded
from tessera.llm.common import kept
from tessera.llm.hashing import mixed, word_hashes, words_of

PASSAGE, STRIDE, BUCKETS, RANK, OVERSAMPLE = 48, 24, 1 << 16, 48, 8
#: What all items weigh in the fit at least, as a share of what all documents weigh: else few items would not count in it.
SHARE = 0.1
#: Items that are searched at once; blocks of words whose latent rows are held at once, and buckets of one row of a sketch.
ITEMS, STEP, PART = 100_000, 4096, 1024
COMMON, MIN_CONTENT = 0.1, 6
COSINE, LIKE, PARAPHRASE, ANSWER, MIN_WORDS, MIN_EXACT, MIN_ANSWER = 0.35, 0.7, 0.5, 0.8, 8, 4, 5
#: The share that an item of common words needs, as those come together by chance.
ALL_LIKE = 0.85


def hashes(words: list[str]) -> np.ndarray:
    """32-bit hashes of words."""
    return split([" ".join(words)])[0]


def split(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    words, sizes, _ = word_hashes(texts)
    words = (words >> np.uint64(32)).astype(np.uint32)
    return np.split(words, np.cumsum(sizes)[:-1]) if len(texts) else []


def buckets(words: np.ndarray) -> np.ndarray:
    return words & np.uint32(BUCKETS - 1)


def plain_words(text: str | None) -> list[str]:
    return words_of(text)


def answer(text: str) -> list[str]:
    """The words of the last sentence or line of an item, with those before it until there are MIN_ANSWER words."""
    out: list[str] = []
    for part in reversed(re.split(r"[.?!\n]+", text)):
        if len(out) < MIN_ANSWER:
            out = plain_words(part) + out
    return out


@dataclass
class Item:
    id: object
    words: list[int]
    masks: dict[int, int]
    answer_masks: dict[int, int]
    n_answer: int
    size: int  # of the whole item
    like: float = LIKE
    least: float = PARAPHRASE


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(found: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of n words, given as bits of their places, with `words`: bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = found.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Index:
    """What a word of each bucket adds to a latent vector, with a last row of zeros; the buckets that items' words fall into;
    (item, bucket) as one sorted number for the items' words; items and their unit vectors; and the items of under MIN_WORDS
    words, whose places among the items follow."""

    projection: np.ndarray
    known: np.ndarray
    keys: np.ndarray
    items: list[Item]
    latent: np.ndarray
    exact: dict[int, dict[int, list[int]]]  # by number of words: by hash, the items


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after another: the starts of their blocks of STRIDE words, the text of each block,
    and whether the next block belongs to the same text."""
    counts = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * STRIDE
    return start, text, np.concatenate([text[1:] == text[:-1], [False]]) if len(text) else np.empty(0, bool)


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the hashes of the words of each document, as bytes, kept so that texts are split once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            found = [x.tobytes() for x in split(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [key, "words"])

    return kept(docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, words binary"), "hashed")


def arrays(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in batch.column(at).to_pylist()]


def document_frequencies(table: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each bucket, and how many documents there are; over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in bounded(batches, "words"):
            found = [buckets(x) for x in arrays(batch, 0)]
            # The document above the bucket: one sort for all documents of the batch.
            tagged = np.concatenate([b.astype(np.int64) + BUCKETS * i for i, b in enumerate(found)]) if found else np.empty(0, np.int64)
            tagged.sort()
            first = np.ones(len(tagged), bool)
            first[1:] = tagged[1:] != tagged[:-1]
            total += np.bincount(tagged[first] & (BUCKETS - 1), minlength=BUCKETS)
            n += len(found)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], ["bucket", "n"])

    rows = table.select("words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows.mapInArrow(packed, "bucket binary, n binary").collect():  # BUCKETS + 1 pairs of numbers in all
        bucket, count = np.frombuffer(r["bucket"], np.int64), np.frombuffer(r["n"], np.int64)
        out[bucket[bucket >= 0]] = count[bucket >= 0]
        n += int(count[bucket < 0].sum())
    return out, n


def padded(bucket: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The buckets of blocks of up to STRIDE words, in as many rows: the first words of all blocks, then the second ones, ...
    BUCKETS where a block has no more words."""
    at = start + np.arange(STRIDE)[:, None]
    return np.where(at < end, bucket[np.minimum(at, len(bucket) - 1)], BUCKETS)


def fit_passages(found: list[np.ndarray], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All passages of texts, given as their words' hashes, in steps: the `padded` blocks, of which the last may be one
    beyond; which passages (one starts with each block) go on with the next; and 1 / the length of each TF-IDF vector."""
    bucket = buckets(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32)
    start, _, more = passages(np.array([len(f) for f in found], np.int64))
    close = np.append(start[1:], len(bucket))
    square = np.append(idf.astype(np.float64) ** 2, 0)
    for i in range(0, len(start), STEP):
        last = min(i + STEP, len(start) - 1)
        blocks = padded(bucket, start[i : last + 1], close[i : last + 1])
        goes_on = more[i : i + STEP]
        after = np.full((STRIDE, len(goes_on)), BUCKETS, blocks.dtype)
        after[:, goes_on] = blocks[:, np.flatnonzero(goes_on) + 1]
        words = np.ascontiguousarray(np.sort(np.concatenate([blocks[:, : len(goes_on)], after]).T, axis=1).T)
        # A word that comes n times counts n * n squares: 1 + 3 + 5 + ...
        odd, size = np.ones(len(goes_on)), square[words[0]]
        for before, word in zip(words[:-1], words[1:], strict=True):
            odd = np.where(word == before, odd + 2, 1)
            size += odd * square[word]
        yield blocks, goes_on, (1 / np.sqrt(size))[:, None].astype(np.float32)


def passage_sums(projection: np.ndarray, blocks: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Sums of the words' rows over each passage."""
    sums = projection.take(blocks[0], axis=0)
    for r in blocks[1:]:
        sums += projection.take(r, axis=0)
    out = sums[: len(goes_on)].copy()
    joined = np.flatnonzero(goes_on)
    out[joined] += sums[joined + 1]
    return out


def add_rows(total: np.ndarray, blocks: np.ndarray, rows: np.ndarray, few: int = 16) -> None:
    """Adds the row of each block to the total of each of its words' buckets. Buckets that come up to `few` times are added
    together, time by time, the other ones each by itself."""
    flat = blocks.ravel()
    some = np.flatnonzero(flat < BUCKETS)
    some = some[np.argsort(flat[some].astype(np.uint16), kind="stable")]
    bucket, block = flat[some], some % blocks.shape[1]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    size = np.diff(np.append(first, len(bucket)))
    light = np.flatnonzero(size <= few)
    light = light[np.argsort(-size[light], kind="stable")]
    if len(light):
        at, n = first[light], size[light]
        sums = rows.take(block[at], axis=0)
        for k in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -k))  # so many come more than k times
            sums[:m] += rows.take(block[at[:m] + k], axis=0)
        total[bucket[at]] += sums
    for k in np.flatnonzero(size > few).tolist():
        total[bucket[first[k]]] += rows.take(block[first[k] : first[k] + size[k]], axis=0).sum(0)


def orthonormal(y: np.ndarray, rows: int = 8192) -> np.ndarray:
    """An orthonormal basis of y's columns, of which there are few: block by block, as numpy works in doubles on copies."""
    parts = [np.linalg.qr(y[i : i + rows]) for i in range(0, len(y), rows)]
    turn, _ = np.linalg.qr(np.concatenate([r for _, r in parts]))
    ends = np.cumsum([len(r) for _, r in parts])
    return np.concatenate([q @ turn[end - len(r) : end] for (q, r), end in zip(parts, ends.tolist(), strict=True)])


def singular_vectors(spark: SparkSession, table: DataFrame, idf: np.ndarray, items: DataFrame | None = None, weight: float = 1.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors (BUCKETS by RANK at most) and singular values of the unit TF-IDF vectors of all passages
    of the table (words), and of the items (words), each of which counts `weight` times.

    Executors make A'(AW) for a random W, summed by bucket; its orthonormal basis Q holds the leading directions after
    a power step. They then make (AQ)'(AQ), whose eigenvectors turn Q into the singular vectors. A task's sketch has a
    fixed size, so a task reads as much as there is for each of two tasks a core, and 8 at least.
    """
    width = RANK + OVERSAMPLE
    tasks = max(8, 2 * spark.sparkContext.defaultParallelism)

    def over_all(make, schema: str) -> DataFrame:
        def run(times: float):
            return lambda batches: make(batches, times)

        out = table.select("words").coalesce(tasks).mapInArrow(run(1.0), schema)
        return out if items is None else out.unionByName(items.select("words").coalesce(tasks).mapInArrow(run(weight), schema))

    def weighted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * idf[:, None], np.zeros((1, width), np.float32)])

    def sketch(batches: Iterator[pa.RecordBatch], times: float) -> Iterator[pa.RecordBatch]:
        w = weighted(np.random.default_rng(seed).standard_normal((BUCKETS, width), np.float32))
        total = np.zeros((BUCKETS, width), np.float32)
        for batch in bounded(batches, "words"):
            for blocks, goes_on, scale in fit_passages(arrays(batch, 0), idf):
                y = passage_sums(w, blocks, goes_on) * scale**2
                z = np.zeros((blocks.shape[1], width), np.float32)
                z[: len(y)] = y
                joined = np.flatnonzero(goes_on)
                z[joined + 1] += y[joined]
                add_rows(total, blocks, z)
        total *= idf[:, None] * np.float32(times)
        for i in range(0, BUCKETS, PART):
            if total[i : i + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i : i + PART].tobytes()], pa.binary())], ["first", "y"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(part.as_buffer(), np.float32)
        for i, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], ["first", "y"])

    # The driver gets PART buckets in a row: it makes no objects for single buckets.
    found = over_all(sketch, "first long, y binary").repartition(8, "first").mapInArrow(summed, "first long, y binary").collect()
    y = np.zeros((BUCKETS, width), np.float32)
    for r in found:
        y[r["first"] : r["first"] + PART] = np.frombuffer(r["y"], np.float32).reshape(-1, width)
    del found
    q = orthonormal(y)
    sent = spark.sparkContext.broadcast(q)

    def gram(batches: Iterator[pa.RecordBatch], times: float) -> Iterator[pa.RecordBatch]:
        total, w = np.zeros((width, width)), weighted(sent.value)
        for batch in bounded(batches, "words"):
            for blocks, goes_on, scale in fit_passages(arrays(batch, 0), idf):
                b = passage_sums(w, blocks, goes_on) * scale
                total += b.T @ b
        total *= times
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    g = sum(np.frombuffer(r["g"]).reshape(width, width) for r in over_all(gram, "g binary").collect())
    sent.destroy()
    values, vectors = np.linalg.eigh(np.atleast_2d(g) + np.zeros((width, width)))
    order = np.argsort(values)[::-1][:RANK]
    size = np.sqrt(np.maximum(values[order], 0))
    some = size > 1e-4 * max(size.max(), 1e-9)
    return q @ vectors[:, order[some]].astype(np.float32), size[some]


def latent(projection: np.ndarray, words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the words' latent rows from each start to the next."""
    return np.add.reduceat(projection.take(buckets(words).astype(np.int64), axis=0), start, axis=0)


def block_sums(projection: np.ndarray, bucket: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the latent rows of blocks of up to STRIDE words: the first words of all blocks, then the second ones, ..."""
    rows = padded(bucket, start, end)
    out = projection.take(rows[0], axis=0)
    for r in rows[1:]:
        out += projection.take(r, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(size, 1e-12)[:, None]


def build(spark: SparkSession, table: DataFrame, items: DataFrame, item_key: str = "item_id") -> list[Index]:
    """Indexes of at most ITEMS items each, on one latent space. table: what `hashed` made of the documents; items: columns
    item_key and text."""
    n = items.count()
    if not n:
        return []
    seen, total = document_frequencies(table)
    idf = (np.log((total + 1) / (seen + 1)) + 1).astype(np.float32)
    asked = hashed(items, item_key, "text")
    blocks = F.coalesce(F.sum(F.ceil(F.octet_length("words") / (4 * STRIDE))), F.lit(0))  # as many as passages
    weight = SHARE * table.agg(blocks).first()[0] / max(1, asked.agg(blocks).first()[0])
    vectors, size = singular_vectors(spark, table, idf, asked, max(1.0, weight))
    if not len(size):
        return []
    projection = np.concatenate([vectors / size * idf[:, None], np.zeros((1, len(size)))]).astype(np.float32)
    rare = seen <= COMMON * total
    out = []
    slices = -(-n // ITEMS)
    for k in range(slices):  # one slice unless the benchmark is very large
        part = items.where(F.pmod(F.xxhash64(item_key, "text"), F.lit(slices)) == k) if slices > 1 else items
        rows = [(r[0], hashes(plain_words(r[1])), hashes(answer(r[1] or ""))) for r in part.select(item_key, "text").collect()]
        short = [r for r in rows if MIN_EXACT <= len(r[1]) < MIN_WORDS]
        rows = [r for r in rows if len(r[1]) >= MIN_WORDS]
        if not rows and not short:
            continue
        made, known, keys = [], np.zeros(BUCKETS, bool), []
        for i, body, last in rows:
            content = body[rare[buckets(body)]]
            limits = (LIKE, PARAPHRASE)
            if len(content) < MIN_CONTENT:
                content, limits = body, (ALL_LIKE, ALL_LIKE)
            known[buckets(content)] = known[buckets(last)] = True
            keys.append(buckets(content).astype(np.int64) + BUCKETS * len(made))
            made.append(Item(i, content.tolist(), masks(content.tolist()), masks(last.tolist()), len(last), len(body), *limits))
        near = np.empty((0, len(size)), np.float32)
        if rows:
            start = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])[:-1]])
            near = unit(latent(projection, np.concatenate([r[1] for r in rows]), start))
        exact: dict[int, dict[int, list[int]]] = {}
        for i, body, _ in short:
            exact.setdefault(len(body), {}).setdefault(int(runs(body, len(body))[0]), []).append(len(made))
            made.append(Item(i, body.tolist(), {}, {}, 0, len(body)))
        out.append(Index(projection, known, np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64), made, near, exact))
    return out


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n successive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out + words[k : len(out) + k].astype(np.uint64) + np.uint64(1))
    return out


def judged(item: Item, around: list[int]) -> tuple[float, bool, bool]:
    """The common share of the item's content, whether its answer is there, and whether that makes a leak."""
    share = lcs(item.masks, len(item.words), around) / len(item.words)
    if share < item.least:
        return share, False, False
    there = item.n_answer > 0 and lcs(item.answer_masks, item.n_answer, around) >= ANSWER * item.n_answer
    return share, there, share >= item.like or there and item.least < item.like


def leaks(index: Index, found: list[np.ndarray]) -> Iterator[tuple[int, int, int, float, float, bool, bool]]:
    """Candidates of each text, given as its words' hashes: text, item, place of the passage, cosine, common share, answer
    found, leak."""
    sizes = np.array([len(f) for f in found], np.int64)
    words = np.concatenate(found) if found else np.empty(0, np.uint32)
    first, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    start, text, more = passages(sizes)
    bucket = buckets(words).astype(np.intp)
    close = np.append(start[1:], len(words))
    known = index.known[bucket]
    upto = np.concatenate([[0], np.cumsum(known)])
    known_bucket = bucket[known]
    for n, by in index.exact.items():
        found_runs = runs(words, n)
        for p in np.flatnonzero(np.isin(found_runs, np.fromiter(by, np.uint64, len(by)))).tolist():
            t = int(np.searchsorted(ends, p, side="right"))
            if p + n <= ends[t]:
                for k in by[int(found_runs[p])]:
                    yield t, k, int(p - first[t]), 1.0, 1.0, True, True
    items = index.items[: len(index.latent)]
    need = np.array([x.least * len(x.words) for x in items])
    reach = np.array([x.size for x in items])  # the item may reach out of the passage on either side
    step = 2048
    for i in range(0, len(start), step):
        last = min(i + step, len(start) - 1)  # one block beyond, for the passage that starts with the last
        sums = block_sums(index.projection, bucket, start[i : last + 1], close[i : last + 1])
        whole = sums[: min(step, len(start) - i)].copy()
        joined = np.flatnonzero(more[i : i + len(whole)])
        whole[joined] += sums[joined + 1]
        whole = unit(whole)
        for j in range(0, len(items), 4096):
            cosine = whole @ index.latent[j : j + 4096].T
            p, k = np.nonzero(cosine >= COSINE)
            t = text[i + p]
            a = np.maximum(start[i + p] - reach[j + k], first[t])
            b = np.minimum(start[i + p] + PASSAGE + reach[j + k], ends[t])
            # A common subsequence can't be longer than the words around that any item has, nor than those that this one has.
            some = upto[b] - upto[a] >= need[j + k]
            p, k, t, a, b = p[some], k[some], t[some], a[some], b[some]
            if not len(p):
                continue
            n = upto[b] - upto[a]
            first_of = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(upto[a] - first_of, n)
            key = known_bucket[at] + BUCKETS * np.repeat(j + k, n)
            place = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
            some = np.add.reduceat((index.keys[place] == key).astype(np.int64), first_of) >= need[j + k]
            for p_, k_, t_, a_, b_ in zip(p[some].tolist(), k[some].tolist(), t[some].tolist(), a[some].tolist(), b[some].tolist(), strict=True):
                around = words[a_:b_][known[a_:b_]].tolist()
                yield t_, j + k_, int(start[i + p_] - first[t_]), float(cosine[p_, k_]), *judged(index.items[j + k_], around)


def search(table: DataFrame, indexes: list[Index], key: str = "doc_id", item_type: str = "bigint") -> DataFrame:
    """A row for each document and item that it leaks: key, item_id, start (word), cosine, share, answer_found. table: what
    `hashed` made of the documents."""
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_type}, start long, cosine double, share double, answer_found boolean"
    out = spark.createDataFrame([], schema)
    for index in indexes:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in bounded(batches, "words"):
                best: dict[tuple[int, int], tuple] = {}
                for t, i, start, cosine, share, there, leak in leaks(index, arrays(batch, 1)):
                    if leak and ((t, i) not in best or (share, cosine, -start) > best[t, i][:3]):
                        best[t, i] = (share, cosine, -start, there)
                rows = [(t, index.items[i].id, -v[2], v[1], v[0], v[3]) for (t, i), v in sorted(best.items())]
                columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], [key, "item_id", "start", "cosine", "share", "answer_found"])

        out = out.unionByName(table.select(key, "words").mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """docs without the rows that leak an item; columns as they were, no shuffle."""
    columns, schema = docs.columns, docs.schema
    for index in indexes:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, text):
                bad = {x[0] for x in leaks(sent.value, split(batch.column(batch.schema.get_field_index(text)).to_pylist())) if x[-1]}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())).select(columns)

        docs = docs.mapInArrow(run, schema)
    return docs
