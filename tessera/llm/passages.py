"""Passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are the lines of LINE_WORDS words or more, and the segments of the whole run of words between content-defined
cuts, for texts without line ends: a word is a cut if its hash is the least within REACH words on either side. Both are
sets of five-word shingles. Paragraphs of the same words are one node; different nodes that share a band of their MinHash
signatures, lines with lines and segments with segments, are candidates, which `components.settled` compares by exact
Jaccard so that no link between two classes is lost among candidates; nodes linked at THRESHOLD or more fall into classes
by connected components.

A passage pasted within a line may hold no whole paragraph, so texts also give anchors: of any WINDOW successive runs of
RUN_WORDS words the one of least hash. Any RUN_WORDS + WINDOW - 1 = 25 words that two documents share give both the same
anchor, and so does one side of a passage of 51 words with a word changed. An anchor is a node that is alike to itself alone.

A class repeats if it holds paragraphs of two documents. Repeated segments and anchors that meet form a run; runs of
RUN_WORDS words or more and repeated lines are reported, cut where what goes meets what stays. Passages of over 50 words are
always found, but the first and last WINDOW - 1 words of one pasted within a line may lie outside its run, and a changed word
ends a run. Boilerplate of under RUN_WORDS words is left alone. In each class the document of the least id keeps its
paragraphs and those of the others go.

Defined results: null texts and texts under five words have no paragraphs; repetition within one document doesn't count;
rows with one id count as one document; rows with a null id are left out; very long texts are read whole; extra columns of
any name are left as they are; an empty table gives an empty result. Places and lengths count the words of
`hashing.word_hashes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import bounded
from tessera.llm.common import free_name, kept, release
from tessera.llm.components import settled, small, within_reach
from tessera.llm.darts import SEEN, SHINGLE, elements
from tessera.llm.hashing import LONGEST, mixed, word_hashes

THRESHOLD, LINE_WORDS, REACH, RUN_WORDS, WINDOW = 0.8, 24, 24, 16, 10
#: 5 bands of 2 find a pair of similarity 0.8 with a probability of 0.994, one of 0.9 with 0.9998.
BANDS, ROWS = 5, 2
_ODD = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(np.iinfo(np.uint64).max)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[:-more], out[more:]) if more else out


class Texts:
    """The words of a batch of texts, one after another, as hashes: of each its text, and whether it ends a line."""

    def __init__(self, texts: list[str | None]):
        self.words, self.sizes, line = word_hashes(texts, lines=True)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.ends_text = np.append(self.text[1:] != self.text[:-1], True) if len(line) else np.empty(0, bool)
        self.ends_line = self.ends_text | np.append(line[1:] != line[:-1], True) if len(line) else self.ends_text

    def cuts(self) -> np.ndarray:
        """Whether each word is a cut: the first of the least words within REACH, all of its own text."""
        h, n = self.words, len(self.words)
        out = np.zeros(n, bool)
        if n > 2 * REACH:
            mid, side = h[REACH : n - REACH], least_of(h, REACH)
            whole = self.text[: n - 2 * REACH] == self.text[2 * REACH :]
            out[REACH : n - REACH] = whole & (mid < side[: n - 2 * REACH]) & (mid <= side[REACH + 1 : n - REACH + 1])
        return out

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start (among all words), length and kind (1 line, 0 segment) of the paragraphs, those of each text together."""
        found = []
        for kind, ends, least in ((0, self.cuts() | self.ends_text, RUN_WORDS), (1, self.ends_line, LINE_WORDS)):
            end = np.flatnonzero(ends) + 1
            start = np.append(0, end)[: len(end)]
            some = end - start >= least
            found.append((start[some], (end - start)[some], np.full(int(some.sum()), kind, np.int32)))
        start, n, kind = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(self.text[start], kind="stable")
        return start[order], n[order], kind[order]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Start (among all words) and node of the anchors, in the same places whatever else is in the batch."""
        if len(self.words) < RUN_WORDS:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        runs, width = self.words, 1
        while width < RUN_WORDS:
            runs = mixed(runs[:-width]) + runs[width:]
            width *= 2
        own = self.text[RUN_WORDS - 1 :] == self.text[: len(runs)]  # between two texts WINDOW or more runs are of no text
        runs = np.where(own, mixed(runs), _MOST)
        edge = np.full(WINDOW - 1, _MOST)
        least = least_of(np.concatenate([edge, runs, edge]), WINDOW)
        # A run is an anchor if it is the least of any window that it is in: the largest of those windows' least values is its own.
        start = np.flatnonzero(own & (~least_of(~least, WINDOW) == runs))
        return start, runs[start].view(np.int64)

    def of_text(self, start: np.ndarray) -> np.ndarray:
        """Offsets of each text's places among those given, which are in the order of texts."""
        return np.searchsorted(self.text[start], np.arange(len(self.sizes) + 1)).astype(np.int32)


def nodes(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each paragraph, in their order."""
    data = words.tobytes()
    found = (xxhash.xxh64_intdigest(data[8 * a : 8 * b]) for a, b in zip(start.tolist(), (start + n).tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(start)).view(np.int64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    out = words[: max(0, len(words) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        out = mixed(out) + words[k : len(out) + k]
    return mixed(out)


def bands(words: np.ndarray, start: np.ndarray, n: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
    """The band keys of each paragraph, paragraphs by BANDS; those of lines and those of segments differ."""
    out = np.empty((len(start), BANDS), np.int64)
    if not len(start):
        return out
    shingles = np.append(shingle_hashes(words), _MOST)
    between = np.stack([start, start + n - SHINGLE + 1], 1).reshape(-1)
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64) + np.asarray(kind).astype(np.uint64) * np.uint64(BANDS)
        for r in range(ROWS):
            drawn = shingles * _ODD[b * ROWS + r]
            drawn ^= drawn >> np.uint64(29)
            drawn *= _STEP
            key = mixed(key ^ np.minimum.reduceat(drawn, between)[::2])
        out[:, b] = key.view(np.int64)
    return out


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("__text"))


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document: id, its paragraphs (kind, start, n, node, bands) and its anchors (start, node). A copy of a
    paragraph that its task has seen has no bands."""
    kind_of_id = docs.schema[key].dataType.simpleString()
    schema = f"id {kind_of_id}, paragraphs array<struct<kind:int,start:int,n:int,node:bigint,bands:array<bigint>>>, anchors array<struct<start:int,node:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches, "__text"):
            t = Texts(batch.column(1).to_pylist())
            start, n, kind = t.paragraphs()
            node = nodes(t.words, start, n)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate((node ^ kind).tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            keys = bands(t.words, start[fresh], n[fresh], kind[fresh])
            of_band = np.concatenate([[0], np.cumsum(fresh) * BANDS]).astype(np.int32)
            its_bands = pa.ListArray.from_arrays(pa.array(of_band), pa.array(keys.reshape(-1)), mask=pa.array(~fresh))
            place = (start - t.first[t.text[start]]).astype(np.int32)
            paragraph = pa.StructArray.from_arrays([pa.array(kind), pa.array(place), pa.array(n.astype(np.int32)), pa.array(node), its_bands], ["kind", "start", "n", "node", "bands"])
            at, its = t.anchors()
            anchor = pa.StructArray.from_arrays([pa.array((at - t.first[t.text[at]]).astype(np.int32)), pa.array(its)], ["start", "node"])
            columns = [pa.ListArray.from_arrays(pa.array(t.of_text(s)), x) for s, x in ((start, paragraph), (at, anchor))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "paragraphs", "anchors"])

    return _source(docs, key, text).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """node and its distinct shingles' hashes, sorted, for the nodes of `places` (id, start, n, node)."""
    by_doc = kept(places.groupBy("id").agg(F.collect_list(F.struct("start", "n", "node")).alias("want")), "wanted")
    rows = _source(docs, key, text).join(small(by_doc), "id").select("__text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            t = Texts(batch.column(0).to_pylist())
            want = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
            start, n, node = (want.flatten().field(k).to_numpy() for k in ("start", "n", "node"))
            there = start + n <= t.sizes[row]  # a row of the same id with another text has other words there
            start, n, node = start[there] + t.first[row[there]], n[there], node[there]
            same = nodes(t.words, start, n) == node
            start, n, node = start[same], n[same], node[same]
            shingles = shingle_hashes(t.words)
            sets = [np.unique(shingles[s : s + m - SHINGLE + 1]).tobytes() for s, m in zip(start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a written table, whose Jaccard similarity reaches the threshold."""
    both = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(small(pairs), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def alike(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared >= threshold * (len(a) + len(b) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "sa"):
            keep = [alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def paragraph_classes(found: DataFrame, docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """node, component of all paragraphs that are linked to another. found: what `parsed` made, written."""
    spark = docs.sparkSession
    rows = found.select(F.explode("paragraphs").alias("p")).where("p.bands is not null").select("p.node", F.explode("p.bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    shared = kept(shared, "paragraph-shared")
    release(spark)
    buckets = kept(rows.join(small(shared), "band", "left_semi").distinct(), "paragraph-buckets")
    release(spark)
    wanted = kept(buckets.select("node").distinct(), "paragraph-wanted")
    places = found.select("id", F.explode("paragraphs").alias("p")).select("id", "p.start", "p.n", "p.node")
    places = places.join(small(wanted), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "start", "n")).alias("at"))
    sets = kept(shingle_sets(docs, key, text, kept(places.select("node", "at.id", "at.start", "at.n"), "paragraph-places")), "paragraph-sets")
    return settled(buckets, lambda pairs: verified(pairs, sets, threshold), lambda open_: within_reach(open_, elements(sets, "shingles"), threshold), "paragraph")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, kind (0 segment, 1 line, 2 anchor), start, n, class (least node) and first_id of all paragraphs and anchors whose
    class spans documents."""
    spark = docs.sparkSession
    found = kept(parsed(docs, key, text), "parsed")
    parts = paragraph_classes(found, docs, key, text, threshold)
    release(spark)
    paragraphs = found.select("id", F.explode("paragraphs").alias("p")).select("id", "p.kind", "p.start", "p.n", "p.node")
    paragraphs = paragraphs.join(small(parts), "node", "left").select("id", "kind", "start", "n", F.coalesce("component", "node").alias("class"))
    anchors = found.select("id", F.explode("anchors").alias("a")).select("id", F.lit(2).alias("kind"), "a.start", F.lit(RUN_WORDS).alias("n"), F.col("a.node").alias("class"))
    rows = paragraphs.unionByName(anchors)
    spans = kept(rows.groupBy("class").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").drop("last_id"), "spans")
    release(spark)
    return rows.join(small(spans), "class").select("id", "kind", "start", "n", "class", "first_id")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Repeated passages: key, kind (line or run), start, n_words, n_paragraphs, classes, first_ids, and whether it goes
    (removed)."""
    rows = kept(repeated(docs, key, text, threshold), "repeated")
    release(docs.sparkSession)
    rows = rows.withColumn("end", F.col("start") + F.col("n")).withColumn("gone", F.col("id") != F.col("first_id")).withColumn("kind", (F.col("kind") == 1).cast("int"))
    order = Window.partitionBy("id", "kind").orderBy("start", "n")
    # A line stands alone; a segment or anchor goes on with the run if it starts where one before ends. A run's size counts as a
    # whole, but what goes and what stays of it are parts of their own.
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when((F.col("kind") == 0) & (before >= F.col("start")), 0).otherwise(1)
    runs = rows.withColumn("fresh", fresh).withColumn("turn", F.when((F.col("fresh") == 0) & (F.lag("gone").over(order) == F.col("gone")), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).withColumn("part", F.sum("turn").over(order))
    parts = runs.groupBy("id", "kind", "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_paragraphs"), F.sort_array(F.collect_set("class")).alias("classes"), F.sort_array(F.collect_set("first_id")).alias("first_ids"), F.first("gone").alias("removed"))
    whole = Window.partitionBy("id", "kind", "run")
    out = parts.withColumn("run_words", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("run_words") >= RUN_WORDS).withColumn("n_words", F.col("end") - F.col("start"))
    return out.select(F.col("id").alias(key), F.when(F.col("kind") == 1, "line").otherwise("run").alias("kind"), "start", "n_words", "n_paragraphs", "classes", "first_ids", "removed")


def spans_to_remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the sorted word spans (start, n) of its repeated passages that aren't the first of their class."""
    rows = report(docs, key, text).where("removed")
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with those words, and what stands between them, cut out of the text; other columns as they were."""
    columns, schema = docs.columns, docs.schema
    other, of = free_name(docs, "__key"), free_name(docs, "__spans")
    joined = docs.join(spans.select(F.col(key).alias(other), F.col("spans").alias(of)), docs[key] == F.col(other), "left").drop(other)
    word = regex.compile(rf"[\p{{L}}\p{{N}}]{{1,{LONGEST}}}")  # as `word_hashes` finds them

    def cut(body: str, want: list[dict]) -> str:
        at = [(m.start(), m.end()) for m in word.finditer(body)]
        out, last = [], 0
        for w in want:
            s, e = w["start"], min(w["start"] + w["n_words"], len(at))
            if s < e and at[e - 1][1] > last:
                out.append(body[last : max(last, at[s][0])])
                last = at[e - 1][1]
        return "".join([*out, body[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            i, j = batch.schema.get_field_index(text), batch.schema.get_field_index(of)
            texts = [cut(t, w) if t and w else t for t, w in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type)).select(columns)

    return joined.mapInArrow(run, schema)
