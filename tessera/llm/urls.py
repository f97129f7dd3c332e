"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features.

The trees are fitted on the driver from a bounded sample of labelled URLs and turned into nested conditionals, so scoring
is a projection of built-in expressions.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the trees' verdict on the
features of an empty string; repeated urls get equal verdicts; without labelled urls of both kinds the model is the prior.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sampled

#: (verdict, host and path); the longest that fits decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "longest_run", "suffix_rate", "suffix_log_count", "ending_rate")


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is this one or above it and whose path starts this one; else null."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}"), F.lit(text)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, from the runs of the sorted characters; 0 for an empty text."""
    n = F.length(text).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    bits = lambda run: F.when(run > 1, run * F.log2(run)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(same, 0.0).otherwise(bits(a["run"]))).alias("sum"))

    total = F.aggregate(F.array_sort(F.array_remove(F.split(text, ""), "")), start, step, lambda a: a["sum"] + bits(a["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last label of the host, and beside it the first folder of the path is the ending: see `features`."""
    return F.substring_index(host, ".", -1)


def ending(path: Column) -> Column:
    """The file suffix of the path, `/` for a folder, else the empty text."""
    return F.when(path.endswith("/"), F.lit("/")).otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1)))


def looked_up(key: Column, table: dict[str, float], other: float) -> Column:
    """A statistic by key as a literal map; the table's size is bounded by the sample."""
    if not table:
        return F.lit(float(other))
    pairs = F.create_map(*(F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))))
    return F.coalesce(F.element_at(pairs, key), F.lit(float(other)))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that need no statistics, in the order of FEATURES."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    gone = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    longest = F.array_max(F.transform(F.split(F.concat_ws("/", host, path), r"[^A-Za-z0-9]+"), F.length))
    return [
        F.length(text).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.size(F.array_remove(F.split(path, "/"), "")).cast("double").alias("depth"),
        (digits / F.greatest(F.length(text), F.lit(1))).alias("digit_ratio"),
        entropy(text).alias("entropy"),
        F.size(F.array_remove(F.split(query, "[&;]"), "")).cast("double").alias("n_params"),
        F.size(F.array_remove(F.split(host, r"\."), "")).cast("double").alias("n_labels"),
        gone(host, "-").cast("double").alias("n_hyphens"),
        F.coalesce(longest, F.lit(0)).cast("double").alias("longest_run"),
    ]


@dataclass
class UrlModel:
    """Trees of (feature, threshold, left, right) or a leaf's value; statistics of suffixes and endings; the prior's log odds."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    rates: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)
    endings: dict[str, float] = field(default_factory=dict)
    base_rate: float = 0.5

    def statistics(self, host: Column, path: Column) -> list[Column]:
        return [
            looked_up(suffix(host), self.rates, self.base_rate).alias("suffix_rate"),
            looked_up(suffix(host), self.counts, 0.0).alias("suffix_log_count"),
            looked_up(ending(path), self.endings, self.base_rate).alias("ending_rate"),
        ]

    def margin(self, feature: dict[str, Column]) -> Column:
        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, at, low, high = node
            return F.when(feature[name] <= at, branch(low)).otherwise(branch(high))

        out = F.lit(float(self.prior))
        for tree in self.trees:
            out = out + branch(tree)
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5) -> tuple[float, list]:
    """Newton boosting of the logistic loss on quantile bins; returns the prior's log odds and the trees."""
    mean = min(max(float(y.mean()), 0.01), 0.99)
    prior, out = float(np.log(mean / (1 - mean))), []
    if len(set(y.tolist())) < 2:
        return prior, out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    f = np.full(len(y), prior)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * total_g / (total_h + 1.0))
        if not left or len(rows) < 2 * least:
            return leaf
        best = (1e-6, 0, 0)
        for j, c in enumerate(cuts):
            k = len(c) + 1
            if k < 2:
                continue
            at = binned[rows, j]
            sum_g, sum_h, n = (np.cumsum(np.bincount(at, w, k))[:-1] for w in (g[rows], h[rows], None))
            gain = sum_g**2 / (sum_h + 1) + (total_g - sum_g) ** 2 / (total_h - sum_h + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[0] <= 1e-6:
            return leaf
        _, j, b = best
        low = binned[rows, j] <= b
        return (FEATURES[j], float(cuts[j][b]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    def value(node, into: np.ndarray, rows: np.ndarray) -> None:
        if not isinstance(node, tuple):
            into[rows] += node
            return
        low = x[rows, FEATURES.index(node[0])] <= node[1]
        value(node[2], into, rows[low])
        value(node[3], into, rows[~low])

    everyone = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = grow(everyone, p - y, p * (1 - p), depth)
        value(tree, f, everyone)
        out.append(tree)
    return prior, out


def fit(labelled: DataFrame, url: str, label: str, limit: int = SAMPLE) -> UrlModel:
    """A model from labelled urls (label 1: block, 0: allow), of which at most `limit` are used, chosen by hash."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("y"))
    rows = sampled(rows, "url", limit, "urls")
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.select("y", suffix(F.col("host")).alias("s"), ending(F.col("path")).alias("e"), *lexical(F.col("url"), F.col("host"), F.col("path"))).collect()
    model = UrlModel()
    if not rows:
        return model
    y = np.array([r["y"] for r in rows])
    model.base_rate = float(y.mean())

    def rate(keys: list[str]) -> dict[str, float]:
        seen: dict[str, list[float]] = {}
        for k, v in zip(keys, y, strict=True):
            seen.setdefault(k, []).append(v)
        return {k: (sum(v) + 5 * model.base_rate) / (len(v) + 5) for k, v in seen.items() if len(v) >= 5}

    names, ends = [r["s"] for r in rows], [r["e"] for r in rows]
    model.rates, model.endings = rate(names), rate(ends)
    model.counts = {k: float(np.log1p(names.count(k))) for k in model.rates}
    more = [[model.rates.get(s, model.base_rate), model.counts.get(s, 0.0), model.endings.get(e, model.base_rate)] for s, e in zip(names, ends, strict=True)]
    x = np.array([[float(r[n]) for n in FEATURES[:-3]] + m for r, m in zip(rows, more, strict=True)])
    model.prior, model.trees = boost(x, y)
    return model


def judge(df: DataFrame, key: str, url: str, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The key, host, path, rule, verdict and block probability of each url."""
    parts = df.select(F.col(key).alias(key), F.col(url).alias("__url"))
    parts = parts.withColumn("host", host(F.col("__url"))).withColumn("path", path(F.col("__url")))
    parts = parts.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    parts = parts.select("*", *lexical(F.col("__url"), F.col("host"), F.col("path")), *model.statistics(F.col("host"), F.col("path")))
    parts = parts.withColumn("__margin", model.margin({n: F.col(n) for n in FEATURES}))
    own = F.when(F.col("__margin") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return parts.select(key, "host", "path", "rule", F.coalesce(rule_verdict(F.col("rule"), rules), own).alias("verdict"), (1 / (1 + F.exp(-F.col("__margin")))).alias("score"))


def rule_labels(df: DataFrame, url: str, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The urls that a rule decides, as labelled urls: column y is 1 for block and 0 for allow."""
    verdict = rule_verdict(rule(host(F.col(url)), path(F.col(url)), rules), rules)
    return df.select(F.col(url), F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("y")).where(F.col("y").isNotNull())
