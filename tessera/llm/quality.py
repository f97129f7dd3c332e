"""Quality rules: text statistics in built-in expressions, and a learned decision list over them.

Sequential covering grows threshold conjunctions for the bad class by information gain on two thirds of a bounded labelled
sample, prunes each on the rest, and removes what it covers. The list becomes an ordered conditional expression.

Defined results: a null text has no words, lines or symbols and fails the base rules, as an empty text does; repeated rows
get equal verdicts; without labels of both kinds the list is empty and every text that passes the base rules is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import among, sampled, words

WINDOW = 5
#: Labelled documents that the list is fitted on, at most.
SAMPLE = 6_000
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, n: Column, hashes: Column) -> Column:
    """Words inside windows of five that occur twice or more, the first occurrence included.

    Hashes are sorted with their places only in texts whose windows aren't all different. Places of windows that recur,
    in order, cover five words each, less what the next one covers too.
    """
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        twin = lambda x, i: (F.get(sorted_, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]) & (i > 0) | (F.get(sorted_, F.least(i + 1, last))["h"] == x["h"]) & (i < last)
        return F.array_sort(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))

    def cover(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("end"), (a["sum"] + F.least(F.lit(WINDOW), i - a["end"]).cast("long")).alias("sum")), lambda a: a["sum"])

    # A transform over a one-element array binds a value once, where naming the expression again would evaluate it again.
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    found = bind(tagged, lambda s: bind(places(s), cover))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0).cast("long"))


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """df and the five statistics of BASE (longs); df must not have columns of these names."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__words", words(F.col(text)))
    size = F.size("__words")
    window = lambda i: F.xxhash64(*(F.get(F.col("__words"), i + k) for k in range(WINDOW)))
    out = out.withColumn("__windows", F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(size - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines)
    return out.select(
        *df.columns,
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words"), size, F.col("__windows")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
    )


def features() -> dict[str, Column]:
    """The features of the list over the statistics' columns, as doubles."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, `<=` or `>`, threshold); a text that meets all is bad."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self, feature: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & ((feature[name] <= at) if op == "<=" else (feature[name] > at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {at:g}" for n, op, at in self.tests)


def verdict(rules: list[Rule], feature: dict[str, Column]) -> Column:
    """True if no rule of the ordered list holds."""
    out = None
    for r in rules:
        out = F.when(r.holds(feature), False) if out is None else out.when(r.holds(feature), False)
    return F.lit(True) if out is None else out.otherwise(True)


def cover(x: np.ndarray, y: np.ndarray, most_rules: int = 8, most_tests: int = 3, least_precision: float = 0.75, least: int = 5) -> list[Rule]:
    """Sequential covering of the rows with y = 1; rows must come in a random order."""
    rules: list[Rule] = []
    grow = np.arange(len(y)) % 3 != 2
    left = np.ones(len(y), bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65), method="lower")) for j in range(x.shape[1])]

    def match(tests, rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for j, op, at in tests:
            out &= (x[:, j] <= at) if op == "<=" else (x[:, j] > at)
        return out

    def purity(rows: np.ndarray) -> float:
        return (y[rows].sum() + 1.0) / (rows.sum() + 2.0)

    while len(rules) < most_rules and (y[left & grow] == 1).sum() >= least:
        tests: list[tuple[int, str, float]] = []
        while len(tests) < most_tests:
            now = match(tests, left & grow)
            before, best = np.log2(max(y[now].mean(), 1e-9)), (0.0, None)
            for j, values in enumerate(cuts):
                for at in values:
                    for op, rows in (("<=", now & (x[:, j] <= at)), (">", now & (x[:, j] > at))):
                        n, bad = rows.sum(), y[rows].sum()
                        if bad < least or n == now.sum():
                            continue
                        gain = bad * (np.log2(bad / n) - before)
                        if gain > best[0] + 1e-9:
                            best = (float(gain), (j, op, float(at)))
            if best[1] is None:
                break
            tests.append(best[1])
            if y[match(tests, left & grow)].mean() >= 0.99:
                break
        if not tests:
            break
        check = left & ~grow
        scored = [(purity(match(tests[:k], check)), -k, tests[:k]) for k in range(1, len(tests) + 1)]
        tests = max(scored, key=lambda s: (round(s[0], 3), s[1]))[2]
        hit = match(tests, left)
        precision = float(y[hit].mean()) if hit.any() else 0.0
        if hit.sum() < least or precision < least_precision or purity(match(tests, check)) < 0.5:
            break
        rules.append(Rule(tuple((FEATURES[j], op, at) for j, op, at in tests), precision, int(hit.sum())))
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int = SAMPLE) -> list[Rule]:
    """The list from labels (1 good, 0 bad) of at most `limit` documents, chosen by hash of the key."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("__y"))
    chosen = sampled(chosen, key, limit, "quality")
    rows = among(docs.select(key, text), chosen, key).join(F.broadcast(chosen), key)
    rows = with_statistics(rows.select(F.col(text).alias("__text"), "__y", key), "__text").drop("__text")
    rows = rows.select(key, (F.col("__y") == 0).cast("double").alias("y"), *(c.alias(f"x_{n}") for n, c in features().items())).orderBy(F.xxhash64(F.lit("order"), key)).collect()
    if not rows:
        return []
    return cover(np.array([[r[f"x_{n}"] for n in FEATURES] for r in rows]), np.array([r["y"] for r in rows]))


def judge(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The key, the statistics of BASE, base_failed and kept of each document."""
    found = with_statistics(docs.select(F.col(key), F.col(text).alias("__text")), "__text").drop("__text")
    found = found.withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules, features())).drop("__n_lines")
