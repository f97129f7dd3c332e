"""Russian stemming as data: ordered steps that Columns and plain Python both carry out.

Regions and the length come from the word as it was; steps never refresh them. Words of under three letters, and words with
other letters than а-я, stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.analysis import is_russian

# Letter classes.
VOWELS = "аеиоуыэюяё"
CONSONANTS = "бвгджзйклмнпрстфхцчшщ"


@dataclass(frozen=True)
class Step:
    """Removal of endings where the original length less `less` reaches the region.

    first: only the longest ending that the word has counts, `less` is its length, and if that is too much nothing goes.
    Otherwise every ending goes in turn from what is left. other: the step tried if the word has none of the endings.
    """

    endings: tuple[str, ...]
    region: str
    less: int = 0
    first: bool = False
    other: Step | None = None

    @property
    def pattern(self) -> str:
        return f"(?:{'|'.join(self.endings)})$"


def _step(endings: str, region: str, less: int = 0, first: bool = False, other: Step | None = None) -> Step:
    return Step(tuple(endings.split()), region, less, first, other)


# Endings, regions and lengths, in the order in which they are tried.
STEPS = (
    _step("ивши ывши ив ыв", "rv", 2, other=_step("вши в", "rv", 1)),
    _step("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею", "r1", first=True),
    _step("ивш ывш ующ", "rv", 3, other=_step("ем нн вш ющ щ", "rv", 2)),
    _step("ся сь", "rv", 2),
    _step("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ют ны ть ешь нно", "rv", first=True),
    _step("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я", "r1", first=True),
    _step("ейш ейше", "r2", 4),
    _step("нн", "r2", 2),
    _step("ь", "r2", 1),
)


def _regions(word: str) -> dict[str, int]:
    n = len(word)

    def after(pattern: str, start: int) -> int:
        found = re.compile(pattern).search(word, start)
        return found.end() if found else n

    pair = f"[{CONSONANTS}][{VOWELS}]"
    r1 = after(pair, 0)
    return {"rv": after(f"[{VOWELS}]", 0), "r1": r1, "r2": after(pair, r1)}


def stem_word(word: str) -> str:
    """The stem of one word, on the driver: for the terms of queries."""
    if len(word) < 3 or not re.fullmatch("[а-я]+", word):
        return word
    at, n = _regions(word), len(word)
    for step in STEPS:
        while step and not re.search(step.pattern, word):
            step = step.other
        if not step:
            continue
        if step.first:
            ending = re.search(step.pattern, word)[0]
            if n - len(ending) >= at[step.region]:
                word = word[: len(word) - len(ending)]
        elif n - step.less >= at[step.region] or n < step.less:  # lengths are unsigned there
            for ending in step.endings:
                word = word.removesuffix(ending)
    return word


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: naming it again in each of nine nested steps would copy the whole
    expression each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stem(word: Column) -> Column:
    """The stem of a word as one expression whose size is linear in the number of steps."""
    pair = f"[{CONSONANTS}][{VOWELS}]"
    found = lambda text, pattern: F.regexp_instr(text, F.lit(pattern))

    def regions(w: Column, then: Callable[[Column, dict[str, Column]], Column]) -> Column:
        n, v = F.length(w), found(w, f"[{VOWELS}]")
        rv = F.when(v > 0, v).otherwise(n)
        r1 = F.when(found(w, pair) > 0, found(w, pair) + 1).otherwise(n)

        def with_r1(x: Column) -> Column:
            p2 = found(F.substring(w, x["r1"] + 1, x["n"]), pair)
            r2 = F.when(p2 > 0, x["r1"] + p2 + 1).otherwise(x["n"])
            return _bound(F.struct(x["n"].alias("n"), x["rv"].alias("rv"), x["r1"].alias("r1"), r2.alias("r2")), lambda y: then(w, {k: y[k] for k in ("n", "rv", "r1", "r2")}))

        return _bound(F.struct(n.alias("n"), rv.alias("rv"), r1.alias("r1")), with_r1)

    def change(step: Step, now: Column, at: dict[str, Column]) -> Column:
        region, n = at[step.region], at["n"]
        if step.first:
            ending = F.regexp_extract(now, step.pattern, 0)
            gone = F.when(n - F.length(ending) >= region, F.substring(now, F.lit(1), F.length(now) - F.length(ending))).otherwise(now)
        else:
            less = now
            for e in step.endings:
                less = F.regexp_replace(less, f"{e}$", "")
            gone = F.when((n - step.less >= region) | (n < step.less), less).otherwise(now)
        return F.when(now.rlike(step.pattern), gone).otherwise(change(step.other, now, at) if step.other else now)

    def steps(now: Column, at: dict[str, Column], k: int = 0) -> Column:
        return now if k == len(STEPS) else _bound(change(STEPS[k], now, at), lambda w: steps(w, at, k + 1))

    stems = _bound(word, lambda w: regions(w, steps))
    return F.when((F.length(word) < 3) | ~is_russian(word), word).otherwise(stems)


def with_stem(df: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """df and the stem of the word in a column of its own."""
    return df.withColumn(out, stem(F.col(word)))


def stem_tokens(tokens: Column) -> Column:
    """The tokens stemmed in their places, empty stems left out. A narrow expression; arrays without Russian words, which one
    search of the joined text tells, are left as they are."""
    stemmed = F.filter(F.transform(tokens, lambda t: F.when(is_russian(t), stem(t)).otherwise(t)), lambda t: t != "")
    return F.when(F.concat_ws(" ", tokens).rlike("[а-я]{3}"), stemmed).otherwise(tokens)
