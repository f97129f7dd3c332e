"""Line deduplication within an edit distance of one word, by a deletion-neighbourhood join.

Two lines are near when one word is substituted, inserted or deleted (case and spacing don't count). A line's variants are
its words with one left out (for each place) and the line itself seen at each gap; both are keyed by the words before and
the words after the place. Lines with an equal key differ in that one place alone, so any two of them are within the
bound: each key's earliest line stands for all, and no pairs are made.

Variants of every word of every line would be many times the text. One edit leaves a half of a line unchanged, so lines
that share neither half (for their own length or one less) with another line can't have a partner and emit no variants,
and the others emit them in the changed half alone. This prefilter loses nothing.

A line is dropped if the same line, or a near one, comes earlier in the order of (id, place in the text). Lines of under
`min_words` words have no near lines, as one edit would make most of them alike; the same line is looked for from
`exact_words` words on (from min_words if that is None; 1 takes every line that has a word). Defined results: empty lines
always stay; a null text has no lines; a null id sorts first; rows repeated whole share their fate; very long texts are read
whole; extra columns of any name are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import free_name, kept

MIN_WORDS = 8
#: Candidate lines up to so many are looked up by broadcast (about 45 MB); more by a shuffle join.
BROADCAST_LINES = 200_000


def _lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Lines of at least min_words words: key, the text's hash, place, words, and the line's identity (hash and length)."""
    # Words come out of the generator, so the filter on their number doesn't split the lines once more.
    # Other white space becomes a space first: to split at one plain character compiles no pattern for each line.
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x09\x0B-\x0D]", " ")
    split = F.transform(F.split(plain, "\n"), lambda line: F.array_remove(F.split(line, " "), ""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(split).alias("place", "words")).where(F.size("words") >= min_words)
    return rows.withColumn("h", F.xxhash64("words")).withColumn("chars", F.length(F.array_join("words", "")))


def _halves(words: Column, n: Column) -> list[tuple[str, Column]]:
    """For the line's own length and one less: the first and the last half, hashed with that length."""
    out = []
    for less in (0, 1):
        m = n - less
        front = F.floor(m / 2).cast("int")
        out.append(("tail", F.xxhash64(F.lit("front"), m, F.slice(words, F.lit(1), front))))
        out.append(("head", F.xxhash64(F.lit("back"), m, F.slice(words, n - (m - front) + 1, m - front))))
    return out


def _variants(lines: DataFrame) -> DataFrame:
    """h, chars, first and a key for each place of the halves named in `sides` at which the line may have been changed."""
    small = lambda c: F.shiftrightunsigned(c, 24)  # sums of 40 bits stay within a long
    n = F.size("words")
    rows = lines.select("h", "chars", "first", "sides", n.alias("n"), F.posexplode("words").alias("i", "word"))
    rows = rows.withColumn("a", small(F.xxhash64(F.lit(1), "word", "i"))).withColumn("z", small(F.xxhash64(F.lit(2), "word", F.col("n") - F.col("i"))))
    whole = Window.partitionBy("h", "chars")
    ahead = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("a").over(ahead)).withColumn("past", F.sum("z").over(whole) - F.sum("z").over(ahead))
    before, after = F.col("upto") - F.col("a"), F.col("past")
    front = F.floor((F.col("n") - 1) / 2)
    wanted = F.array_contains("sides", "tail") & (F.col("i") >= front) | F.array_contains("sides", "head") & (F.col("i") <= F.col("n") - F.col("n") / 2 + 1)
    gone = F.struct(F.col("n") - 1, before, after)  # without this word
    gap = F.struct(F.col("n"), before, after + F.col("z"))  # the gap before this word
    last = F.when(F.col("i") == F.col("n") - 1, F.struct(F.col("n"), F.col("upto"), F.lit(0).cast("long")))  # the gap at the end
    keys = F.array_compact(F.array(F.xxhash64(gone), F.xxhash64(gap), F.when(last.isNotNull(), F.xxhash64(last))))
    return rows.where(wanted).select("h", "chars", "first", F.explode(keys).alias("key"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two different word arrays are one substitution, insertion or deletion apart."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.zip_with(short, F.slice(long_, F.lit(1), F.size(short)), lambda x, y: x == y)
    p = F.coalesce(F.array_position(same, F.lit(False)).cast("int") - 1, F.size(short))
    p = F.when(p < 0, F.size(short)).otherwise(p)  # words that both start with
    rest = lambda w, at: F.slice(w, at + 1, F.greatest(F.size(w) - at, F.lit(0)))
    return F.when(F.size(a) == F.size(b), rest(a, p + 1) == rest(b, p + 1)).when(F.size(long_) == F.size(short) + 1, rest(short, p) == rest(long_, p + 1)).otherwise(False)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """id, row (hash of the text), place of every line that goes, and the id and place of the line that it repeats."""
    n = F.size("words")
    rows = _lines(docs, key, text, min_words if exact_words is None else min(exact_words, min_words))
    halves = F.when(n >= min_words, F.array(*(k for _, k in _halves(F.col("words"), n))))  # without halves a line is near none
    at = kept(rows.select("id", "row", "place", "h", "chars", halves.alias("halves")), "lines")
    first = F.min(F.struct("id", "place")).alias("first")
    distinct = kept(at.groupBy("h", "chars").agg(first, F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves")), "distinct-lines")

    sides = F.array(*(F.lit(s) for s in ("tail", "head", "tail", "head")))
    halves = distinct.select("h", "chars", "first", F.explode(F.arrays_zip(F.col("halves").alias("half"), sides.alias("side"))).alias("x")).select("h", "chars", "first", "x.half", "x.side")
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    near = halves.join(shared, "half", "left_semi").groupBy("h", "chars").agg(F.first("first").alias("first"), F.collect_set("side").alias("sides"))
    near = kept(near, "near-lines")

    few = near.count() <= BROADCAST_LINES
    # Only texts in which such a line comes first are split once more.
    name = free_name(docs, "__first")
    ids = near.select(F.col("first.id").alias(name)).distinct()
    there = docs.join(F.broadcast(ids) if few else ids, docs[key].eqNullSafe(F.col(name)), "left_semi")
    texts = _lines(there, key, text, min_words).select("h", "chars", "words", "id", "place").join(F.broadcast(near) if few else near, ["h", "chars"])
    texts = texts.where((F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("place") == F.col("first.place")))
    texts = kept(texts.groupBy("h", "chars").agg(F.first("first").alias("first"), F.first("sides").alias("sides"), F.first("words").alias("words")), "near-texts")

    variants = _variants(texts)
    heads = variants.groupBy("key").agg(F.min(F.struct("first", "h", "chars")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = variants.join(heads, "key").where((F.col("head.h") != F.col("h")) | (F.col("head.chars") != F.col("chars")))
    links = links.groupBy("h", "chars").agg(F.min("head").alias("head"))
    mine, theirs = texts.alias("m"), texts.select(F.col("h").alias("oh"), F.col("chars").alias("ochars"), F.col("words").alias("others"))
    links = links.join(mine.select("h", "chars", "words"), ["h", "chars"]).join(theirs, (F.col("head.h") == F.col("oh")) & (F.col("head.chars") == F.col("ochars")))
    links = links.where(_one_edit(F.col("words"), F.col("others"))).select("h", "chars", F.col("head.first").alias("near"))

    # The witness of a line is the earlier of the line's own first place and the near line's. A line that occurs once and is
    # near none stays; the others' fates are written, so that both sides of the last join are plain reads and a very common
    # line's occurrences can be split.
    fate = distinct.select("h", "chars", "first", "copies").join(links, ["h", "chars"], "left").where("copies > 1 or near is not null")
    fate = kept(fate.select("h", "chars", F.least("first", F.coalesce("near", "first")).alias("witness")), "fates")
    out = at.select("id", "row", "place", "h", "chars").join(fate, ["h", "chars"])
    out = out.where(~(F.col("id").eqNullSafe(F.col("witness.id")) & (F.col("place") == F.col("witness.place"))))
    return out.select("id", "row", "place", F.col("witness.id").alias("first_id"), F.col("witness.place").alias("first_place"))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """A row for each document: key, n_lines, n_dropped, dropped (places in order), first_ids (where they stay)."""
    gone = dropped_lines(docs, key, text, min_words, exact_words).distinct()
    gone = gone.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("place", "first_id"))).alias("gone"))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("row"), F.size(F.split(F.col(text), "\n")).alias("n"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["id"]) & (rows["row"] == gone["row"]), "left")
    found = F.coalesce("gone", F.array().cast(gone.schema["gone"].dataType))
    return joined.select(rows["id"].alias(key), F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.size(found).cast("long").alias("n_dropped"), found["place"].alias("dropped"), F.array_distinct(found["first_id"]).alias("first_ids"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """docs with the dropped lines taken out of the text, and all other columns as they were."""
    at, row, places = (free_name(docs, n) for n in ("__id", "__row", "__gone"))
    gone = dropped_lines(docs, key, text, min_words, exact_words).distinct().groupBy(F.col("id").alias(at), F.col("row").alias(row)).agg(F.collect_set("place").alias(places))
    joined = docs.join(gone, docs[key].eqNullSafe(gone[at]) & (F.xxhash64(docs[text]) == gone[row]), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.coalesce(places, F.array().cast("array<int>")), i))
    return joined.select(*(F.when(F.col(places).isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else docs[c] for c in docs.columns))
