"""Language identification, word first.

A word seen in training scores its log frequency in each language. An unseen word falls back to its character n-grams of
four, then three, two and one, and scores the mean of those of the longest length of which any was seen.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if nothing was learned;
equal scores go to the language that sorts first; repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import Ids, bounded, pieces, plain, split_words, word_ids
from tessera.llm.common import among, sampled

#: Training documents for each language and in all; words kept of those that they hold.
PER_LANG, SAMPLE, WORDS = 1_500, 24_000, 150_000
LONGEST, UNKNOWN, LETTERS = 4, "und", r"\p{L}"


def grams(word: str, n: int) -> list[str]:
    text = f"<{word}>" if n > 1 else word
    return [text[i : i + n] for i in range(len(text) - n + 1)]


@dataclass
class LangModel:
    """Languages in order, their log prior, known words and their log frequencies, and those of n-grams by length."""

    langs: list[str]
    prior: np.ndarray
    words: list[str]
    scores: np.ndarray
    grams: list[dict[str, np.ndarray]]

    def unseen(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for k, word in enumerate(words):
            for n in range(LONGEST, 0, -1):
                table = self.grams[n]
                found = [table[g] for g in grams(word, n) if g in table]
                if found:
                    out[k] = sum(found) / len(found)
                    break
        return out


def log_frequencies(counts: dict[str, np.ndarray], smooth: float = 0.5) -> dict[str, np.ndarray]:
    if not counts:
        return {}
    total = sum(counts.values())
    base = np.log(total + smooth * len(counts))
    return {k: (np.log(v + smooth) - base).astype(np.float32) for k, v in counts.items()}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel:
    """Learns from docs' texts and non-null languages, at most PER_LANG documents of each, chosen by hash of the key."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "key"), "key"))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), plain(F.col(text), LETTERS).alias("text"))
    # Of a language with many rows only those below a hash that PER_LANG and a margin pass are ranked: no task sorts a language.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), (PER_LANG + 8 * PER_LANG**0.5 + 64) / F.col("n"))
    chosen = rows.select("key", "lang").join(F.broadcast(sizes), "lang").where(F.xxhash64(F.lit("lang"), "key").cast("double") <= share * float(1 << 64) - float(1 << 63))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= PER_LANG)
    rows = among(rows, sampled(chosen, "key", SAMPLE, "lang"), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in bounded(batches, "text"):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in pieces(t):
                    seen[k].update(split_words(p))
        flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    found = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.col("n").desc(), "lang", "word").limit(2 * WORDS).collect()
    langs = sorted({r["lang"] for r in found})
    at = {k: i for i, k in enumerate(langs)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for r in found:
        counts[r["word"]][at[r["lang"]]] += r["n"]
    tables = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(LONGEST + 1)]
    for word, n in counts.items():
        for k in range(1, LONGEST + 1):
            for g in grams(word, k):
                tables[k][g] += n
    frequent = sorted(counts, key=lambda w: (-counts[w].sum(), w))[:WORDS]
    scores = log_frequencies(counts)
    held = sum(counts.values()) if counts else np.zeros(0)
    return LangModel(langs, np.log((held + 1) / (held + 1).sum()) if langs else held, frequent, np.array([scores[w] for w in frequent], np.float32).reshape(len(frequent), len(langs)), [{}, *(log_frequencies(t) for t in tables[1:])])


def predict(docs: DataFrame, model: LangModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score (0 to 1, tempered for long texts) of each document, over its whole text."""
    kind = docs.schema[key].dataType.simpleString()
    many = np.array(model.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(model.words, model.scores, model.unseen) if model.langs else None
        for batch in bounded(batches, "__text"):
            n = batch.num_rows
            names, sure = np.full(n, UNKNOWN, object), np.zeros(n)
            if ids is not None:
                found = [word_ids(ids, t) for t in batch.column(1).to_pylist()]
                rows = ids.settle()
                size = np.array([len(f) for f in found])
                some = size > 0
                if some.any():
                    starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    total = np.add.reduceat(rows[np.concatenate([f for f, s in zip(found, some, strict=True) if s])], starts, axis=0, dtype=np.float64)
                    total = model.prior + total * np.minimum(1.0, 20.0 / size[some])[:, None]
                    best = total.argmax(1)
                    odds = np.exp(total - total.max(1, keepdims=True))
                    names[some], sure[some] = many[best], odds.max(1) / odds.sum(1)
                ids.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(sure)], [key, "lang_pred", "score"])

    return docs.select(F.col(key), plain(F.col(text), LETTERS).alias("__text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
