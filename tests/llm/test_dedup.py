"""Near-duplicate classes, repeated passages, components and the pipeline, against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import darts, hashing, passages, queries
from tessera.llm.components import components, settled, within_reach

DOC = "doc_id long, text string"


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bag(text):
    w = plain(text)
    return collections.Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def similarity(a, b):
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def union(n, links):
    top = {i: i for i in n}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {i: find(i) for i in n}


def true_classes(rows):
    bags = {i: bag(t) for i, t in rows if t is not None}
    links = [(a, b) for a in bags for b in bags if a < b and (bags[a] == bags[b] or similarity(bags[a], bags[b]) >= 0.8)]
    return union([i for i, _ in rows], links)


def copies(seed=1, groups=12, words=120):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    rows, i = [], 0
    for _ in range(groups):
        base = say(words)
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 99)}"
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = copies(seed)
    got = {r["doc_id"]: r["class_id"] for r in darts.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == true_classes(rows)


def test_class_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "!!"), (5, "a b"), (6, "A, b!"), (7, "x " * 3000), (8, "x " * 3000 + "y"), (9, "lone text of six words here"), (9, "lone text of six words here"), (None, "a b")]
    got = sorted(((r["doc_id"] or 0, r["class_id"]) for r in darts.classes(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (9, 9), (0, 5)], key=str)
    kept = darts.one_of_each(spark.createDataFrame(rows, DOC).withColumn("__key", F.lit(0)).withColumn("__node", F.lit("n")))
    assert kept.columns == ["doc_id", "text", "__key", "__node"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 9]
    assert darts.classes(spark.createDataFrame([], DOC)).count() == 0 and darts.one_of_each(spark.createDataFrame([], DOC)).count() == 0


def test_large_group_makes_few_pairs(spark):
    """Copies of one text, each with a change of its own, are one class though most pairs are never compared."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(150)] = f"only{i}"
        w[rng.randrange(150)] = f"also{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in darts.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == true_classes(rows) and set(got.values()) == {0}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    repeats = np.tile(a[:60], 3)
    words = np.concatenate([a, repeats, a[:200], repeats[:120], rng.integers(0, 2**63, 80, dtype=np.uint64), a[:3]])
    sizes = np.array([480, 0, 400, 3])
    its, counts = darts.units(words, sizes)
    ends = np.cumsum(counts)
    own = [its[e - n : e] for e, n in zip(ends, counts, strict=True)]
    assert counts.tolist() == [476, 0, 396, 1]
    bags = [collections.Counter(tuple(words[s + i : s + i + 5].tolist()) for i in range(n)) for s, n in ((0, 476), (480, 396))]
    true = similarity(*bags)
    assert darts.jaccard(own[0], own[2]) == pytest.approx(true) and 0.4 < true < 0.9
    k = 4000
    signs = darts.signatures(its, counts, k)
    assert abs((signs[0] == signs[2]).mean() - true) < 0.03
    # The same text has the same units and the same signature whatever else is in the batch, a text of one unit too.
    for i, (s, n) in enumerate(((0, 480), (480, 0), (480, 400), (880, 3))):
        alone = darts.units(words[s : s + n], np.array([n]))
        assert (alone[0] == own[i]).all() and (darts.signatures(*alone, 100) == darts.signatures(its, counts, 100)[i]).all()
    keys = darts.band_keys(signs[:, :100], 20)
    assert keys.shape == (4, 20) and not set(keys[0].tolist()) & set(keys[3].tolist())


def test_a_plain_signature_is_the_same():
    """The darts of each unit one after another, in plain Python."""
    rng = np.random.default_rng(3)
    k, text = 8, rng.integers(0, 2**63, 30, dtype=np.uint64)
    mix = lambda x: int(hashing.mixed(np.array([x], np.uint64))[0])
    rank = (k * np.log(k) + 2 * k) / len(text)
    while True:
        best = {}
        for u in text.tolist():
            at, number = 0.0, 0
            while True:
                dart = mix((u + number * int(darts._ODD[2])) % 2**64)
                at -= np.log(((dart >> 12) + 0.5) * 2.0**-52)
                if at >= rank:
                    break
                spot = mix(dart ^ int(darts._ODD[3]))
                best[spot % k] = min(best.get(spot % k, (np.inf, 0)), (at, spot >> 40))
                number += 1
        if len(best) == k:
            break
        rank *= 2
    got = darts.signatures(text, np.array([len(text)]), k)[0]
    assert [x & 0xFFFFFF for x in got.tolist()] == [best[c][1] for c in range(k)]


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5)], [(9, 1), (1, 9), (2, 9)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    true = union({x for l in links for x in l}, links)
    assert got == {n: c for n, c in true.items() if any(n in l for l in links if l[0] != l[1])}


def test_components_without_coalescing(spark):
    """Links over many partitions, so that no task sees them all: chains, a cycle and a large star."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rng = random.Random(2)
        links = [(i, i + 1) for i in range(1000, 1100)] + [(0, i) for i in range(1, 60)] + [(500 + i, 500 + (i + 1) % 30) for i in range(30)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(220)]
        rng.shuffle(links)
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()}
        true = union({x for l in links for x in l}, links)
        assert got == {n: c for n, c in true.items() if any(n in l for l in links if l[0] != l[1])}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_components_of_more_links_than_a_task_holds(spark, monkeypatch):
    """The rounds of stars and the one task give the same components."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1100)] + [(0, i) for i in range(1, 60)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(220)] + [(7, 7)]
    rows = spark.createDataFrame(links, "a long, b long").repartition(16)
    one = sorted(map(tuple, components(rows).select("node", "component").collect()))
    monkeypatch.setattr("tessera.llm.components.LINKS", 0)
    assert one == sorted(map(tuple, components(rows).select("node", "component").collect()))


def test_few_links_take_few_tasks(spark):
    """Whatever the number of shuffle partitions, if nothing coalesces them: each small step used to take as many tasks."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base] * 5 + [f"{base} x{i}" for i in range(20)] + [f"{base} {' '.join(f'y{i % 4}{j}' for j in range(9))} z{i}" for i in range(40)] + [f"n{i} " * 9 for i in range(20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "67")
    sc = spark.sparkContext
    try:
        sc.setJobGroup("few links", "few links")
        got = {r["doc_id"]: r["class_id"] for r in darts.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("few links") for s in sc.statusTracker().getJobInfo(j).stageIds}
        found = [x.numTasks for s in stages if (x := sc.statusTracker().getStageInfo(s))]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got[0] == 0 and got[64] == 0 and all(got[i] == i for i in range(65, 85))
    assert sum(n >= 67 for n in found) < 10  # 25 before


def test_reach_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    bases = rng.integers(0, 2**62, (4, 60))
    sets = [np.unique(np.concatenate([bases[i % 4][rng.random(60) < 0.93], rng.integers(0, 2**62, rng.integers(0, 4))])) for i in range(60)]
    table = darts.elements(spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in enumerate(sets)], "node long, units binary"))
    rows = spark.createDataFrame([(b, n, n % 20) for b in range(5) for n in range(60) if rng.random() < 0.7], "band long, node long, component long")
    band = collections.defaultdict(list)
    for b, n, c in rows.collect():
        band[b].append((n, c))
    want = {(a, b, ca, cb) for ns in band.values() for a, ca in ns for b, cb in ns if a < b and ca != cb and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    few = {tuple(r) for r in within_reach(rows, table, 0.8).collect()}
    monkeypatch.setattr("tessera.llm.components.REACH_ROWS", 0)
    assert few == want == {tuple(r) for r in within_reach(rows, table, 0.8).collect()} and len(want) > 50


def test_buckets_are_settled_whatever_their_heads(spark):
    """Random buckets: the components are those of all pairs in a bucket that are alike, though few pairs are tested."""
    for seed in range(2):
        rng = random.Random(seed)
        group = {n: rng.randint(0, 12) for n in range(150)}
        buckets = {(b, n) for b in range(40) for n in rng.sample(range(150), rng.choice([2, 3, 12, 40]))}
        likes = lambda a, b: group[a] == group[b] and (a * b) % 3 > 0  # noqa: E731, B023
        by = collections.defaultdict(list)
        for b, n in buckets:
            by[b].append(n)
        true = union(set(group), {(x, y) for ns in by.values() for x in ns for y in ns if x < y and likes(x, y)})
        like = F.udf(lambda a, b: likes(a, b), "boolean")  # noqa: B023
        table = spark.createDataFrame(sorted(buckets), "band long, node long")

        def possible(rows):
            x, y = (rows.select("band", F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
            return x.join(y, "band").where("a < b and ca <> cb").drop("band")

        parts = {r["node"]: r["component"] for r in settled(table, lambda pairs: pairs.where(like("a", "b")), possible, "test").collect()}  # noqa: B023
        assert {n: parts.get(n, n) for n in group} == true


def test_copies_under_one_key(spark):
    """Rows that share a key and not a text: only the row that is a copy goes."""
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, say(1)), (9, say(1)), (9, say(2)), (9, say(2)), (7, say(3)), (None, say(1)), (11, None), (11, None)]
    left = darts.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in left) == sorted([(5, say(1)), (9, say(2)), (7, say(3)), (0, say(1)), (11, "")])


def test_near_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_dart_minhash(spark, sf).collect()}
    assert got == true_classes(rows)


# --- passages --------------------------------------------------------------------------------------------------------


def repeats(rows, n):
    seen, hit = {}, set()
    for i, t in rows:
        w = plain(t or "")
        for k in range(len(w) - n + 1):
            j = seen.setdefault(tuple(w[k : k + n]), i)
            if j != i:
                hit |= {i, j}
    return hit


def test_passages_in_the_midst_of_lines(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    shared = [say(60) for _ in range(10)]
    header = say(10)
    rows = []
    for i in range(60):
        body = say(rng.randint(20, 200))
        if i % 3 == 0:
            body += " " + shared[i // 3 % 10] + " " + say(30)
        rows.append((i, header + "\n" + body))
    rows += [(70, None), (71, ""), (72, "a b"), (73, say(80)), (73, say(80)), (None, rows[0][1]), (74, (say(12) + "\n") * 1 + "z " * 500)]
    got = passages.report(spark.createDataFrame(rows, DOC)).collect()
    flagged = {r["doc_id"] for r in got}
    assert flagged == repeats([r for r in rows if r[0] is not None], 51)
    assert any(r["removed"] for r in got) and all(r["n_words"] >= passages.RUN_WORDS for r in got)
    assert passages.report(spark.createDataFrame([], DOC)).count() == 0


def test_near_paragraphs(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 4000)}" for _ in range(90)]
    other = words[:40] + ["changed"] + words[41:]
    rows = [(1, " ".join(words)), (2, "intro\n" + " ".join(other)), (3, " ".join(f"v{k}" for k in range(90)))]
    got = [r for r in passages.report(spark.createDataFrame(rows, DOC)).collect() if r["kind"] == "line"]
    assert {(r["doc_id"], r["removed"]) for r in got} == {(1, False), (2, True)}
    df = spark.createDataFrame(rows, DOC).withColumn("note", F.lit("n"))
    left = {r["doc_id"]: r["text"] for r in passages.without_spans(df, passages.spans_to_remove(df)).collect()}
    assert left[1] == rows[0][1] and left[2] in ("intro\n", "") and left[3] == rows[2][1]  # the first segment is near with "intro" too


def test_paragraph_parts():
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    inside = say(600)
    texts = [f"{say(17)} {inside} {say(9)}", None, f"{say(30)}\n{say(12)} {inside} {say(9)}", "", "z " * 50]
    t = passages.Texts(texts)
    assert t.sizes.tolist() == [626, 0, 651, 0, 50] and t.first.tolist() == [0, 626, 626, 1277, 1277]
    start, n, kind = t.paragraphs()
    assert (n[kind == 0] >= passages.RUN_WORDS).all() and sorted(n[kind == 1].tolist()) == [30, 50, 621, 626]
    node = passages.nodes(t.words, start, n)
    by = [set(node[(kind == 0) & (t.text[start] == k)].tolist()) for k in (0, 2)]
    assert len(by[0] & by[1]) >= 6
    assert n[(kind == 0) & (t.text[start] == 4)].tolist() == [50]
    # A cut is the first of the least hashes within REACH, and segments reach from cut to cut.
    own = t.words[:626].tolist()
    cuts = [i for i in range(passages.REACH, 626 - passages.REACH) if min(range(i - passages.REACH, i + passages.REACH + 1), key=lambda j: (own[j], j)) == i]
    ends = sorted((start + n)[(kind == 0) & (t.text[start] == 0)].tolist())
    assert [e - 1 for e in ends if e < 626] == [c for c, last in zip(cuts, [-1, *cuts], strict=False) if c - last >= passages.RUN_WORDS]
    # A text has the same paragraphs in any batch.
    alone = passages.Texts([texts[2]])
    s1, n1, k1 = alone.paragraphs()
    assert sorted(passages.nodes(alone.words, s1, n1).tolist()) == sorted(node[t.text[start] == 2].tolist())
    assert len(passages.Texts([None]).paragraphs()[0]) == 0 and len(passages.Texts([]).anchors()[0]) == 0


def test_anchors_by_brute_force():
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randint(0, 3)}" for _ in range(n)) for n in (15, 16, 25, 200)]
    t = passages.Texts(texts)
    start, node = t.anchors()
    width, window = passages.RUN_WORDS, passages.WINDOW
    for k, text in enumerate(texts):
        w = text.split()
        mine = start[t.text[start] == k]
        runs = {int(s - t.first[k]): tuple(w[s - t.first[k] : s - t.first[k] + width]) for s in mine}
        assert all(len(r) == width for r in runs.values())
        # Every window of runs holds an anchor, and equal runs have equal nodes.
        for a in range(max(0, len(w) - width + 1 - window + 1)):
            assert any(a <= p < a + window for p in runs)
        assert len(w) < width or runs
    by = collections.defaultdict(set)
    for s, x in zip(start.tolist(), node.tolist(), strict=True):
        by[tuple(t.words[s : s + width].tolist())].add(x)
    assert all(len(x) == 1 for x in by.values())


def near_corpus(seed, lines=72, words=100):
    """Lines that are copies of a few bases with up to 4 words changed, each in a document of its own, among others."""
    rng = random.Random(seed)
    base = [[f"b{k}x{rng.randint(0, 9999)}" for _ in range(words)] for k in range(6)]
    rows = []
    for i in range(lines):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(words)] = f"n{rng.randint(0, 99999)}"
        rows.append((seed * 1000 + i, " ".join(w)))
    return rows


def test_recall_of_near_paragraphs(spark):
    """All pairs at 0.8 or more by brute force, over twelve corpora, are in one class but for bands that miss them."""
    corpora = [near_corpus(seed) for seed in range(1, 13)]
    df = spark.createDataFrame([r for c in corpora for r in c], DOC)
    got = {r["id"]: r["class"] for r in passages.repeated(df).where("kind = 1").collect()}
    pairs = found = wrong = 0
    for rows in corpora:
        sets = {i: {*bag(t)} for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        true = union([i for i, _ in rows], links)
        pairs += len(links)
        found += sum(got.get(a, a) == got.get(b, -b) for a, b in links)
        wrong += sum(a < b and got.get(a, a) == got.get(b, -b) and true[a] != true[b] for a in sets for b in sets)
    assert pairs > 1000 and found >= 0.99 * pairs and not wrong


def test_passage_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    flagged = {r["doc_id"] for r in queries.op5_paragraph_dedup(spark, sf).collect()}
    must = repeats(rows, 51)
    assert len(flagged & must) >= 0.97 * len(must) and flagged <= repeats(rows, passages.RUN_WORDS)


def test_long_words_are_the_same_in_any_batch():
    rng = random.Random(8)
    odd = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(33, 200))) for _ in range(30))
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))
    plain_english = "the cat sat on a mat " * 400
    for text in (odd, chinese, odd + "\n" + chinese):
        seen = []
        for texts in ([text], [text, plain_english], [plain_english, text, "x" * 70], [plain_english * 20, None, text]):
            t = passages.Texts(texts)
            k = texts.index(text)
            seen.append(t.words[t.first[k] : t.first[k] + t.sizes[k]].tolist())
        assert all(x == seen[0] for x in seen) and len(seen[0]) == len(hashing.words_of(text))


def test_words_of_pieces():
    """Words are where a plain pattern finds them, equal words and no others have equal hashes, wherever texts are cut."""
    rng = random.Random(14)
    odd = ["É", "straße", "x_y", "a-b", "日本", "²³", "\x00\x01", "İstanbul", "q" * 33, "\u0301e", "١٢", "😀", "Ⅷ", "\n", " ", "word", "Word"]
    many = "".join(rng.choice(odd) + rng.choice(["", " ", ", "]) for _ in range(60_000))
    texts = [many, None, "", "ab " * 3 + "q" * (3 * hashing.PIECE) + " end", "漢" * (2 * hashing.PIECE + 5), "\n\nlast\nline"]
    found, sizes, line = hashing.word_hashes(texts, lines=True)
    words = [hashing.words_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    low = lambda w: "".join(x if len(x := c.lower()) == 1 else c for c in w)
    by = {}
    for h, w in zip(found.tolist(), (w for ws in words for w in ws), strict=True):
        assert by.setdefault(h, low(w)) == low(w) or "i" in w
    assert len(set(by.values())) >= len(by) - 2
    assert line[-1] - line[-2] == 1 and line[-2] - line[-3] == 2 and (np.diff(line) >= 0).all()


def test_spans_count_cut_words(spark):
    rng = random.Random(9)
    shared = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    long = "q" * 100
    other = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(90)) for _ in range(2)]  # so that the whole text is no near copy
    rows = [(1, shared), (2, f"{long} {other[0]} start\n{shared}\nend {other[1]} {long}")]
    df = spark.createDataFrame(rows, DOC)
    left = {r["doc_id"]: r["text"] for r in passages.without_spans(df, passages.spans_to_remove(df)).collect()}
    assert left[1] == shared and not set(left[2].split()) & set(shared.split()[6:-6]) and left[2].startswith(f"{long} {other[0]} start") and left[2].endswith(f"end {other[1]} {long}")


def test_what_comes_first_stays_beside_what_goes(spark):
    rng = random.Random(10)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    p, x = say(90), say(90)
    rows = [(1, f"{p} {say(40)}"), (5, f"{say(30)} {p} {x} {say(30)}"), (9, f"{say(35)} {p} {x} {say(30)}")]
    df = spark.createDataFrame(rows, DOC)
    left = {r["doc_id"]: r["text"].split() for r in passages.without_spans(df, passages.spans_to_remove(df)).collect()}
    assert set(p.split()) <= set(left[1]) and len(left[1]) == 130
    inner = x.split()[24:]  # a segment may lie across the border of p and x
    assert set(inner) <= set(left[5]) and set(p.split()[24:66]).isdisjoint(left[5])
    assert set(x.split()[:66]).isdisjoint(left[9]) and set(p.split()[24:]).isdisjoint(left[9])
    got = [r for r in passages.report(df).collect() if r["kind"] == "run" and r["doc_id"] == 5]
    assert {r["removed"] for r in got} == {True, False}


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    found, pairs = 0, 4000
    for _ in range(pairs):  # 45 shingles, of which 40 are shared: similarity 0.8
        words = rng.integers(0, 2**63, 49, dtype=np.uint64)
        both = np.concatenate([words, words[5:], rng.integers(0, 2**63, 5, dtype=np.uint64)])
        keys = passages.bands(both, np.array([0, 49]), np.array([49, 49]))
        found += bool((keys[0] == keys[1]).any())
    assert found >= 0.988 * pairs  # 0.994 expected


def test_buckets_are_settled_beyond_their_heads(spark):
    """A and B are alike, and the head of their bucket, a third node, is like neither."""
    words = lambda *parts: np.concatenate([np.arange(a, b, dtype=np.int64) for a, b in parts])
    sets = {1: words((0, 40), (100, 140)), 2: words((0, 40), (200, 240)), 3: words((0, 40), (200, 238), (300, 302)), 4: words((0, 40), (400, 440)), 5: words((0, 40), (400, 439), (500, 501))}
    table = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "node long, shingles binary")
    buckets = spark.createDataFrame([(7, n) for n in sets], "band long, node long")
    assert passages.verified(spark.createDataFrame([(1, n) for n in (2, 3, 4, 5)], "a long, b long"), table, 0.8).count() == 0
    reach = lambda rows: within_reach(rows, darts.elements(table, "shingles"), 0.8)
    got = {r["node"]: r["component"] for r in settled(buckets, lambda pairs: passages.verified(pairs, table, 0.8), reach, "test").collect()}
    assert got == {2: 2, 3: 2, 4: 4, 5: 4}
    open_ = spark.createDataFrame([(7, n, n) for n in sets], "band long, node long, component long")
    assert {(r["a"], r["b"]) for r in reach(open_).collect()} == {(2, 3), (4, 5)}


def test_no_passage_of_51_words_is_missed(spark):
    """Exact, or with any one word changed, in the midst of lines."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    rows = []
    for k in range(400):
        passage = say(51)
        changed = list(passage)
        if k % 2:
            changed[k // 2 % 51] = "other"
        for i, p in enumerate((passage, changed)):
            rows.append((2 * k + i, " ".join(say(rng.randint(30, 90)) + p + say(rng.randint(30, 90)))))
    rows += [(5000 + k, " ".join(say(120))) for k in range(50)]
    got = passages.report(spark.createDataFrame(rows, DOC)).collect()
    assert {r["doc_id"] for r in got} == set(range(800))
    # Anchors are the same in any batch.
    texts = [t for _, t in rows[:5]] + [None, "a b", " ".join(say(16))]
    t = passages.Texts(texts)
    start, node = t.anchors()
    for k, x in enumerate(texts):
        alone = passages.Texts([x]).anchors()
        assert alone[0].tolist() == (start[t.text[start] == k] - t.first[k]).tolist() and alone[1].tolist() == node[t.text[start] == k].tolist()


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tessera.llm.common import kept, read

    docs = read(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = kept(stage(spark, docs, sf), name)
        assert docs.columns == columns
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == set(true_classes(rows).values())
        counts.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[-1] and last.where("shard between 0 and 15").count() == counts[-1]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0  # what the first stage drops: test_toxicity_stage_on_known_rows


def test_toxicity_stage_on_known_rows(spark, tmp_path):
    """Toxic documents go, clean ones stay, the labelled and the held-out ones alike."""
    import zlib

    import corpus_pipeline

    rng = random.Random(15)
    rows = []
    for i in range(400):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(10, 120))]
        if i % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword"]))
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame([r[:2] for r in rows], DOC), str(tmp_path)).collect()}
    for held in (False, True):
        mine = [(i in left, y) for i, _, y in rows if (zlib.crc32(str(i).encode()) % 4 == 2) == held]
        assert sum(not stays for stays, y in mine if y) >= 0.9 * sum(y for _, y in mine)
        assert sum(stays for stays, y in mine if not y) >= 0.97 * sum(1 - y for _, y in mine)


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies int"
    odd = [(1, None, None, None, None, "s", 1), (2, "", "", "", 0, None, None), (3, "same words here", "en", "a", 1, "s", 1), (3, "same words here", "en", "a", 1, "s", 1), (None, "no id at all", "en", "a", 1, "s", 1), (4, "long " * 20_000, "en", "a", 1, "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert out.columns == [*docs.columns, "shard_"] and out.count() == docs.count()
