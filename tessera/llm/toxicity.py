"""Toxicity of whole documents: a bidirectional recurrent network scores every window of words; the worst window counts.

Windows of WINDOW words start every STRIDE words and the last ends with the text, so all words are seen and any phrase of
WINDOW - STRIDE + 1 words lies whole in some window. The network learns which windows come from documents labelled toxic.
A logistic curve over the highest logit, weighted back to the labels' own rates, gives the score; it is fitted by
cross-fitting, on logits of documents that the network in question didn't see, so few labels do as well.

Defined results: a null text and a text without words score `Model.empty`, the curve's value below all of its training
documents; repeated rows get equal scores; very long texts are read whole; extra columns of any name are left as they are;
without labels of both kinds every score is the share of toxic labels (0 with no label at all); an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import Ids, bounded, plain, split_words, word_ids
from tessera.llm.common import free_name, held_out, kept, sampled
from tessera.llm.gru import STRIDE, WINDOW, Adam, Network, trigrams

#: Training documents of each class, windows of one of them, windows of each class; words of the vocabulary.
SAMPLE, PER_TEXT, WINDOWS, VOCABULARY = 1_500, 256, 10_000, 20_000
BATCH, STEPS, THRESHOLD, FOLDS = 256, 240, 0.3, 2


@dataclass
class Model:
    network: Network | None
    slope: float
    shift: float
    empty: float

    def scores(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def starts(n: int) -> np.ndarray:
    """The first words of the windows of a text of n words."""
    if n <= 0:
        return np.empty(0, np.int64)
    return np.minimum(np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE), max(0, n - WINDOW))


def windows(found: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts (by WINDOW ids) and the number of windows of each text."""
    sizes = np.array([len(f) for f in found])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    each = [starts(n) for n in sizes.tolist()]
    counts = np.array([len(e) for e in each])
    flat = np.concatenate([*found, np.full(1, pad, np.int32)])
    at = np.concatenate(each) + np.repeat(first, counts) if len(each) else np.empty(0, np.int64)
    ends = np.repeat(first + sizes, counts)
    places = at[:, None] + np.arange(WINDOW)
    return flat[np.where(places < ends[:, None], places, len(flat) - 1)], counts


def worst_windows(network: Network, ids: Ids, texts: list[str | None]) -> np.ndarray:
    """The highest logit of each text's windows; -inf for a text without words. Row 0 of the ids is no word."""
    found = [word_ids(ids, t) for t in texts]
    rows = ids.settle()
    wide, counts = windows(found, 0)
    out = np.full(len(texts), -np.inf)
    if len(wide):
        some = counts > 0
        logits = network.logits(rows, wide, 0)
        out[some] = np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum(counts[some])[:-1]]))
    ids.trim()
    return out


def word_rows(network: Network) -> Ids:
    known = ["", *network.words]  # no word is empty, so row 0 is that of no word
    rows = np.concatenate([network.pad(), network.inputs(network.words, known=True)])
    return Ids(known, rows, network.inputs)


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> Network:
    """A network from windows, as `plain` texts in random order, and the labels of their documents."""
    rng = np.random.default_rng(seed)
    tokens = [split_words(t) for t in texts]
    seen = Counter(w for t in tokens for w in set(t))
    least = 2 if len(y) < 4000 else 4
    words = sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:VOCABULARY]
    network = Network.fresh(words, seed)

    vocabulary = {w: i + 1 for i, w in enumerate(words)}
    distinct: dict[str, int] = {"": 0}
    wide = np.zeros((len(tokens), WINDOW), np.int32)
    for row, t in zip(wide, tokens, strict=True):
        row[: len(t)] = [distinct.setdefault(w, len(distinct)) for w in t[:WINDOW]]
    of_word = np.array([vocabulary.get(w, 0) for w in distinct], np.int32)
    flat, sizes = trigrams(list(distinct))
    grams = np.split(flat, np.cumsum(sizes)[:-1])
    chosen = np.arange(len(y))
    adam = Adam(network.p)
    batch = min(BATCH, max(16, len(chosen) // 8))
    epochs = max(3, -(-STEPS * batch // len(chosen)))
    for epoch in range(epochs):
        rng.shuffle(chosen)
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(chosen), batch):
            part = wide[chosen[i : i + batch]]
            here, spread = np.unique(part, return_inverse=True)
            spread = spread.reshape(part.shape)
            word = of_word[part]
            word[rng.random(word.shape) < 0.1] = 0  # some words are read by their characters alone
            _, g = network.gradients(word, (np.concatenate([grams[k] for k in here]), sizes[here]), spread, y[chosen[i : i + batch]].astype(np.float32), part == 0)
            adam.step(g)
    return network


def curve(x: np.ndarray, t: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and shift of a lightly bound logistic curve from logits to labels, classes weighted to the rate of toxic ones."""
    if not len(x):
        return 1.0, 0.0
    mean, scale = float(x.mean()), max(float(x.std()), 1e-6)
    z = (x - mean) / scale  # else large logits saturate the first steps
    weight = np.where(t == 1, rate / max(t.sum(), 1), (1 - rate) / max((1 - t).sum(), 1)) * len(t)
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum() + 0.05 * (a - 1) ** 2 + 0.005 * b * b)
    a, b = 1.0, float(np.log(rate / (1 - rate)))
    for _ in range(100):  # Newton steps, halved until the loss falls
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        r, s = weight * (q - t), weight * q * (1 - q)
        grad = np.array([(r * z).sum() + 0.1 * (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        step, now = np.linalg.solve(hess, grad), loss(a, b)
        while loss(a - step[0], b - step[1]) > now and abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-7:
            break
    a = max(a, 0.05)
    return a / scale, b - a * mean / scale


def sample_windows(rows: DataFrame) -> DataFrame:
    """y, fold, number (a hash) and text of windows of the rows (__y, __fold, __text), at most PER_TEXT of each: those of the
    lowest hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            out = []
            for y, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                found = [" ".join(words[a : a + WINDOW]) for a in starts(len(words)).tolist()]
                out += sorted((xxhash.xxh64_intdigest(f) - (1 << 63), y, fold, f) for f in found)[:PER_TEXT]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["number", "y", "fold", "text"])

    return rows.select("__y", "__fold", "__text").mapInArrow(run, "number long, y int, fold int, text string")


def networks(found: DataFrame, folds: int) -> list[Network]:
    """A network from all of the windows, a bounded sample, and one without each of the first `folds` folds. Each learns in
    a task of its own, so that the driver holds no training data."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        own = [r for r in table.to_pylist() if r["fold"] != number - 1]
        own.sort(key=lambda r: (xxhash.xxh64_intdigest(r["text"]), r["y"], r["fold"]))
        made = train([r["text"] for r in own], np.array([r["y"] for r in own]), 10 + number if number else 7)
        return pa.table({"number": pa.array([number], pa.int32()), "made": pa.array([pickle.dumps(made)], pa.binary())})

    each = found.withColumn("number", F.explode(F.array(*(F.lit(k) for k in range(folds + 1)))))
    each = each.repartition(4 * (folds + 1), "number")  # a number given is kept, so that the networks learn side by side
    made = {r["number"]: r["made"] for r in each.groupBy("number").applyInArrow(run, "number int, made binary").collect()}
    return [pickle.loads(made[k]) for k in sorted(made)]


def worst_logits(rows: DataFrame, networks: list[Network]) -> tuple[np.ndarray, np.ndarray]:
    """The highest logit of each of the rows by the network of its fold, and its label; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [word_rows(n) for n in networks]
        for batch in bounded(batches, "__text"):
            y, fold, texts = (c.to_pylist() for c in batch.columns)
            worst = np.full(len(texts), -np.inf)
            for k, network in enumerate(networks):
                mine = [i for i, f in enumerate(fold) if f == k]
                if mine:
                    worst[mine] = worst_windows(network, known[k], [texts[i] for i in mine])
            yield pa.RecordBatch.from_arrays([pa.array(worst), pa.array(y, pa.int32())], ["worst", "y"])

    found = rows.select("__y", "__fold", "__text").mapInArrow(run, "worst double, y int").collect()  # of the bounded sample
    found = [r for r in found if np.isfinite(r["worst"])]
    return np.array([r["worst"] for r in found]), np.array([r["y"] for r in found], float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled documents that aren't held out: at most SAMPLE of each class, chosen by hash of the key, and at
    most PER_TEXT windows of one and WINDOWS of a class, chosen by hash of their words. Texts are read on executors."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("__y"))
    rates = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    total = sum(rates.values())
    rate = rates.get(1, 0) / total if total else 0.0
    if not rates.get(0) or not rates.get(1):
        return Model(None, 0.0, 0.0, rate)
    chosen = [(r[key], c, i % FOLDS) for c in (0, 1) for i, r in enumerate(sampled(known.where(F.col("__y") == c).select(key), key, SAMPLE, "toxic").collect())]
    of = spark.createDataFrame(chosen, f"__key {labels.schema[key].dataType.simpleString()}, __y int, __fold int")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__raw")).join(F.broadcast(of), F.col("__id") == F.col("__key"))
    rows = kept(rows.select("__y", "__fold", plain(F.col("__raw")).alias("__text")), "labelled")
    windows_ = kept(sample_windows(rows), "windows")
    found = [sampled(windows_.where(F.col("y") == c), "number", WINDOWS, "windows") for c in (0, 1)]
    found = kept(found[0].unionByName(found[1]), "training")
    seen = {(r["y"], r["fold"]) for r in found.select("y", "fold").distinct().collect()}
    if len({y for y, _ in seen}) < 2:
        return Model(None, 0.0, 0.0, rate)
    network, *apart = networks(found, FOLDS if all(len({y for y, f in seen if f != k}) == 2 for k in range(FOLDS)) else 0)
    x, t = worst_logits(rows, apart or [network] * FOLDS)  # else a class is of one document
    slope, shift = curve(x, t, rate)
    model = Model(network, slope, shift, 0.0)
    model.empty = float(model.scores(np.array([x.min() if len(x) else -5.0]))[0])
    return model


def batch_scores(model: Model, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    ids = word_rows(model.network) if model.network else None
    for batch in bounded(batches, text):
        if ids is None:
            yield batch, np.full(batch.num_rows, model.empty)
            continue
        worst = worst_windows(model.network, ids, batch.column(batch.schema.get_field_index(text)).to_pylist())
        yield batch, np.where(np.isfinite(worst), model.scores(worst), model.empty)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the score of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in batch_scores(model, batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [key, "score"])

    return docs.select(F.col(key), plain(F.col(text)).alias("__text")).mapInArrow(run, f"`{key}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; columns as they were, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in batch_scores(model, batches, name):
            yield batch.filter(pa.array(found < threshold)).select(columns)

    columns, name = docs.columns, free_name(docs, "__plain")
    return docs.withColumn(name, plain(F.col(text))).mapInArrow(run, docs.schema)
