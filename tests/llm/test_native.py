"""The operators in built-in expressions, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, mixing, quality, queries, sharding, urls
from tessera.llm.common import free_name, held_out, words

DOC = "doc_id long, text string"
TEXTS = [(1, "one two three"), (2, None), (3, ""), (4, " \t\n"), (None, "no id"), (5, "one two three"), (5, "one two three"), (6, "é " * 30), (7, "x" * 5000)]
WORD = re.compile("[^\x20\x09-\x0d]+")


def md5_draw(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16)


def test_words_and_held_out(spark):
    rows = spark.createDataFrame(TEXTS, DOC).select("doc_id", "text", words(F.col("text")).alias("w"), held_out(F.col("doc_id")).alias("h")).collect()
    for r in rows:
        assert r["w"] == WORD.findall(r["text"] or "")
        assert r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)


# --- sharding --------------------------------------------------------------------------------------------------------


def best(key, n):
    return min((-math.log((md5_draw("shard", key, str(j)) + 0.5) / 2**52), j) for j in range(n))[1]


def test_shards_equal_brute_force_and_grow_into_the_new_one(spark):
    rows = spark.range(400).select(sharding.place(F.col("id"), [1.0] * 16).alias("a"), sharding.place(F.col("id"), [1.0] * 17).alias("b"), "id").collect()
    assert all(r["a"] == best(str(r["id"]), 16) and r["b"] in (r["a"], 16) for r in rows)
    moved = sum(r["b"] == 16 for r in rows)
    assert 5 <= moved <= 50


def test_shards_follow_weights(spark):
    n = spark.range(4000).select(sharding.place(F.col("id"), [3.0, 1.0, 0.0]).alias("s")).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in n}
    assert set(counts) == {0, 1} and abs(counts[0] / 4000 - 0.75) < 0.04
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), [0.0])


def test_slots_are_gapless_with_nulls_and_repeats(spark):
    df = spark.createDataFrame(TEXTS * 3, DOC).select("doc_id", F.length("text").alias("n"))
    df = sharding.assign_shards(df, "doc_id", [1.0, 1.0])
    out = sharding.number_slots(df, "doc_id", "shard", ["doc_id", "n", "shard"]).collect()
    assert len(out) == len(TEXTS) * 3
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.number_slots(df.limit(0), "doc_id", "shard", ["doc_id", "n", "shard"]).count() == 0


def test_shard_name_does_not_clash(spark, tmp_path):
    df = spark.range(10).withColumn("Shard", F.lit("mine"))
    out = sharding.assign_shards(df, "id", [1.0, 1.0])
    assert out.columns == ["id", "Shard", "shard_"] and out.where("Shard = 'mine'").count() == 10
    assert free_name(df, "id") == "id_"
    sharding.write_shards(spark.range(10), "id", [1.0, 1.0], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10


def test_shard_query(spark, sf):
    got = queries.op6_rendezvous_shards(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        body = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["shard"] == best(str(r["doc_id"]), 16) and r["grown_shard"] in (r["shard"], 16)


# --- mixing ----------------------------------------------------------------------------------------------------------


def levelled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] >= most * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in free}
        for n in over:
            target[n] = float(most * sizes[n])
            left -= target[n]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1, "b": 1, "c": 100}, {"a": 0, "b": 9}, {"b": 4}, {"é": 3, "z": 50, "Z": 1, "": 8}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(df, "source", "size").collect()}
    for k, t in levelled(sizes).items():
        assert got[k]["target"] == pytest.approx(t) and got[k]["source_size"] == sizes[k]
        assert 0 <= got[k]["rate"] <= 3


def test_mix_emits_what_it_counts(spark):
    rows = [(i, f"s{i % 3}" if i % 3 else None, "w " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("mine")).withColumn("rate", F.lit(1))
    sized = df.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    targets = mixing.source_targets(sized, "source", "size")
    counted = mixing.with_copies(sized, "doc_id", "source", targets)
    want = {r["doc_id"]: r["copies_"] for r in counted.collect()}
    out = mixing.mix(df, "doc_id", "source", targets)
    assert out.columns == df.columns
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert {k: v for k, v in want.items() if v} == dict(got) and max(want.values()) <= 3
    assert mixing.mix(df.limit(0), "doc_id", "source", targets).count() == 0


def test_large_source_tables_are_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 5}", 3) for i in range(50)], "doc_id long, source string, size long")
    targets = mixing.source_targets(df, "source", "size")
    few = sorted(mixing.with_copies(df, "doc_id", "source", targets).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.with_copies(df, "doc_id", "source", targets).collect()) == few


def test_mix_query(spark, sf):
    got = queries.op3_source_mix(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    per = collections.Counter()
    for i, r in docs.items():
        per[r["source"]] += size[i]
    target = levelled(dict(per))
    for r in got:
        s = docs[r["doc_id"]]["source"]
        rate = min(target[s] / per[s], 3) if per[s] else 0
        u = (md5_draw("mix", str(r["doc_id"])) + 0.5) / 2**52
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["size"] * (math.floor(rate) + (u < rate - math.floor(rate)))
    assert sorted(queries.op3_source_mix(spark, sf).collect()) == sorted(got)


# --- urls ------------------------------------------------------------------------------------------------------------

URLS = [
    "https://WWW.Example.com/en/1?q=2#f", "http://a.example.com/en/", "http://a.example.com/fr/", "https://x.net/es/1", "https://x.net/en/1", "nourl", None, "",
    "ftp://example.com", "https://example.com?x=/en/", "https://example.com#/en/", "https://u:p@h.net:80/fr/x", "a://b://c/d", "https://sub.www.example.com/en/x", "https://notexample.com/en/1", "https://É.COM/x", "x://h\n.com/p\nq",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [r for _, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    rows = df.select("u", urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p")).withColumn("r", urls.rule(F.col("h"), F.col("p"))).collect()
    for r in rows:
        assert (r["h"], r["p"]) == parts(r["u"]), r["u"]
        assert r["r"] == ruled(r["h"], r["p"]), r["u"]


def test_entropy(spark):
    texts = ["", "a", "aab", "abcd", "https://x.example/é", "z" * 3000 + "y"]
    for t, e in spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t"))).collect():
        n = collections.Counter(t)
        assert e == pytest.approx(-sum(v / len(t) * math.log2(v / len(t)) for v in n.values()) if t else 0, abs=1e-9)


def test_boosted_trees_learn_and_match_their_expression(spark):
    rows = [(f"https://h{i}.example.{'biz' if i % 2 else 'edu'}/{'x' * (i % 9)}?a={i}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, y int")
    model = urls.fit(df, "url", "y")
    got = urls.judge(df, "url", "url", model, rules=()).collect()
    want = dict(rows)
    assert all((r["verdict"] == "block") == bool(want[r["url"]]) for r in got)
    assert model.trees and all(0 <= r["score"] <= 1 for r in got)


def test_url_edges(spark):
    empty = urls.fit(spark.createDataFrame([], "url string, y int"), "url", "y")
    one = urls.fit(spark.createDataFrame([("https://a.b/c", 1)], "url string, y int"), "url", "y")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for model in (empty, one):
        rows = urls.judge(df, "page_id", "url", model).collect()
        assert len(rows) == len(URLS) and {r["verdict"] for r in rows} <= {"allow", "block"}
        for r in rows:
            if r["rule"]:
                assert r["verdict"] == dict((b, a) for a, b in urls.RULES)[r["rule"]]
    assert urls.judge(df.limit(0), "page_id", "url", one).count() == 0


def test_url_query(spark, sf):
    got = queries.op4_url_filter(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    labelled = urls.rule_labels(spark.read.parquet(f"{sf}/pages.parquet"), "url").withColumn("k", F.xxhash64("url") % 3)
    model = urls.fit(labelled.where("k <> 0"), "url", "y")
    rest = labelled.where("k = 0").select("url", "y")
    joined = urls.judge(rest, "url", "url", model, rules=()).join(rest, "url").collect()
    right = np.mean([(r["verdict"] == "block") == bool(r["y"]) for r in joined])
    assert right >= 0.7


# --- quality ---------------------------------------------------------------------------------------------------------


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


STATS = ["", None, "a", "a " * 9, "a b c d e a b c d e", "a b c d e f a b c d e", "l1\nl1\n\n \nl1 \nl2", "#|<>&%$* x", "x " * 200 + "\n" + "y\n" * 50, "a b c d e x a b c d e y b c d e x", "é\x0bü\x0c日本", "w" * 2000, "a b a b a b a b"]


def test_statistics_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(STATS)), DOC)
    for r in quality.judge(df, "doc_id", "text", []).collect():
        want = statistics(STATS[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want, STATS[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])


def test_cover_finds_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((1500, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.7) & (x[:, 3] <= 0.4)).astype(float)
    rules = quality.cover(x, y)
    assert rules
    hit = np.zeros(len(y), bool)
    for r in rules:
        part = np.ones(len(y), bool)
        for name, op, at in r.tests:
            v = x[:, quality.FEATURES.index(name)]
            part &= v <= at if op == "<=" else v > at
        hit |= part
    assert (hit == (y == 1)).mean() > 0.95
    assert quality.cover(x, np.zeros(len(y))) == []


def test_quality_query(spark, sf):
    got = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    assert all(tuple(r[c] for c in quality.BASE) == statistics(docs[i]) for i, r in got.items())
    plan = queries.op9_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    labels = [(got[r["doc_id"]]["kept"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    good = [k for k, q in labels if q == 1]
    assert np.mean(good) > 0.9


# --- lines -----------------------------------------------------------------------------------------------------------


def near(a, b):
    """Whether two word tuples are at most one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def dropped(rows, least=lines.MIN_WORDS):
    every = sorted((i, p, tuple(x.split())) for i, t in rows if t is not None and i is not None for p, x in enumerate(t.lower().split("\n")) if len(x.split()) >= least)
    out = collections.defaultdict(set)
    for i, p, w in every:
        if any((j, q) < (i, p) and near(w, v) for j, q, v in every):
            out[i].add(p)
    return out


def test_lines_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(7, 14))] for _ in range(40)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[k : k + (kind != 1)] = [] if kind == 2 else ["new" + str(rng.randint(0, 3))]
            body.append(" ".join(w).upper() if rng.random() < 0.1 else "  ".join(w))
        rows.append((i, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "short line\nshort line"), (103, " ".join("t" + str(k) for k in range(3000)))]
    got = {r["doc_id"]: r for r in lines.dedup_report(spark.createDataFrame(rows, DOC)).collect()}
    want = dropped(rows)
    assert sum(map(len, want.values())) > 30
    for i, t in rows:
        assert set(got[i]["dropped"]) == want.get(i, set()), i
        assert got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1) and got[i]["n_dropped"] == len(want.get(i, ()))


def test_one_slot_templates_are_one_group(spark):
    text = "this is a line with a number {} in the middle of it"
    rows = [(i, text.format(i)) for i in range(200)]
    out = lines.dedup(spark.createDataFrame(rows, DOC).withColumn("h", F.lit(1)))
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "h"] and kept[0] == text.format(0) and not any(v for k, v in kept.items() if k)


def test_lines_edges(spark):
    long = "one two three four five six seven eight nine"
    rows = [(1, long), (1, long), (None, long), (2, long + " ten"), (3, None)]
    got = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in lines.dedup_report(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]
    assert lines.dedup_report(spark.createDataFrame([], DOC)).count() == 0


def test_short_lines_repeat_exactly(spark, tmp_path):
    """Of short lines exact repeats go, whatever their length, and near ones stay; longer ones are near as before."""
    long = "one two three four five six seven eight nine"
    rows = [(1, "Read more\nfoot\n" + long), (2, "read  MORE\nread less\n\n\n" + long + " ten"), (3, "foot\nfour words of five"), (4, "four words of six\nFoot\n "), (5, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_dropped"], r["dropped"], r["first_ids"]) for r in queries.op10_near_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, [], []), 2: (2, [0, 4], [1]), 3: (1, [0], [1]), 4: (1, [1], [1]), 5: (0, [], [])}
    left = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, DOC), exact_words=1).collect()}
    assert left == {1: rows[0][1], 2: "read less\n\n", 3: "four words of five", 4: "four words of six\n ", 5: None}


def test_line_query_drops_every_exact_repeat(spark, sf):
    seen, want = set(), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        for place, line in enumerate((r["text"] or "").lower().split("\n")):
            key = tuple(WORD.findall(line))
            if key and key in seen:
                want.add((r["doc_id"], place))
            seen.add(key)
    assert any(want) and want <= {(r["doc_id"], p) for r in queries.op10_near_line_dedup(spark, sf).collect() for p in r["dropped"]}
