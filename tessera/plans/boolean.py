"""Boolean queries: a lexer and operator-precedence parser on the driver, a plan for Catalyst.

Words AND and OR (any case) and parentheses are operators; other runs of characters are terms, which are normalised and
stemmed but neither split nor checked for stop-words. Where operators stand isn't checked, only that each finds two
operands and one value is left, so `AND a b` means `a AND b`. Errors give no rows and a message.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.analysis import LOWER, NOT_NORMAL, UPPER
from tessera.operators.stem import stem_word

PRIORITY = {"AND": 2, "OR": 1}
_FOLD = str.maketrans(UPPER, LOWER)


class QueryError(ValueError):
    """A query that can't be evaluated."""


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Op:
    name: str
    left: Node
    right: Node


Node = Term | Op


def analyze_term(word: str) -> str:
    """The term as the index has it; a term with a separator inside keeps a space there and so matches nothing."""
    return stem_word(re.sub(NOT_NORMAL, " ", word.translate(_FOLD)).strip(" "))


def lex(query: str | None) -> list[str | Term]:
    out: list[str | Term] = []
    for m in re.finditer(r"[()]|[^\s()]+", query or "", re.ASCII):
        word = m[0]
        out.append(word if word in "()" else word.upper() if word.upper() in PRIORITY else Term(analyze_term(word)))
    return out


def postfix(tokens: list[str | Term]) -> list[str | Term]:
    """Terms and operators in the order of evaluation; QueryError for unbalanced parentheses."""
    out: list[str | Term] = []
    held: list[str] = []
    for t in tokens:
        if isinstance(t, Term):
            out.append(t)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise QueryError("unbalanced parentheses")
            held.pop()
        else:
            while held and held[-1] != "(" and PRIORITY[held[-1]] >= PRIORITY[t]:
                out.append(held.pop())
            held.append(t)
    while held:
        if held[-1] == "(":
            raise QueryError("unbalanced parentheses")
        out.append(held.pop())
    return out


def parse(query: str | None) -> Node:
    stack: list[Node] = []
    for t in postfix(lex(query)):
        if isinstance(t, Term):
            stack.append(t)
        elif len(stack) < 2:
            raise QueryError(f"{t} lacks an operand")
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(Op(t, left, right))
    if len(stack) != 1:
        raise QueryError("not one expression")
    return stack[0]


def error(query: str | None) -> str | None:
    """What is wrong with the query, or None."""
    try:
        parse(query)
    except QueryError as e:
        return str(e)
    return None


def terms(node: Node) -> list[str]:
    """The distinct terms in order."""
    if isinstance(node, Term):
        return [node.text]
    return list(dict.fromkeys(terms(node.left) + terms(node.right)))


def simplify(node: Node, df: dict[str, int]) -> Node | None:
    """The node without what can't match, None if nothing can. df: document frequencies of the known terms. Of the
    operands of an AND the rarer comes first."""
    if isinstance(node, Term):
        return node if df.get(node.text) else None
    left, right = simplify(node.left, df), simplify(node.right, df)
    if node.name == "OR":
        return Op("OR", left, right) if left and right else left or right
    if not (left and right):
        return None
    low = lambda n: min(df[t] for t in terms(n))
    return Op("AND", left, right) if low(left) <= low(right) else Op("AND", right, left)


def predicate(node: Node, has: dict[str, Column]) -> Column:
    if isinstance(node, Term):
        return has[node.text]
    left, right = predicate(node.left, has), predicate(node.right, has)
    return left & right if node.name == "AND" else left | right


def nothing(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.lit(False))


def search_postings(postings: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame:
    """The keys that match, from rows (term, key): one scan pruned to the query's terms, one partial aggregate, one shuffle
    of the matching postings."""
    try:
        node = parse(query)
    except QueryError:
        return nothing(postings, key)
    wanted = terms(node)
    flags = [F.max(F.col("term") == t).alias(f"__{i}") for i, t in enumerate(wanted)]
    found = postings.where(F.col("term").isin(wanted)).groupBy(key).agg(*flags)
    return found.where(predicate(node, {t: F.col(f"__{i}") for i, t in enumerate(wanted)})).select(key)


def search_index(index: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame:
    """The keys that match, from a persisted index: the terms are pushed down to the scan, and the lists of a block
    meet in that block alone, as bounded arrays; only the answer is exploded."""
    try:
        node = parse(query)
    except QueryError:
        return nothing(index.select(F.explode("postings").alias(key)), key)
    known = {r["term"]: r["df"] for r in index.where(F.col("term").isin(terms(node))).select("term", "df").distinct().collect()}  # a row for each term of the query
    node = simplify(node, known)
    rows = index.select("term", F.explode("postings").alias(key))
    if node is None:
        return nothing(rows, key)
    if isinstance(node, Term):
        return rows.where(F.col("term") == node.text).select(key)
    wanted = terms(node)
    return index.where(F.col("term").isin(wanted)).groupBy("block").agg(*lists_of(wanted)).select(F.explode(folded(node, wanted)).alias(key))


def lists_of(wanted: list[str]) -> list[Column]:
    """The posting list of each term among the rows of a group, empty if it has none."""
    empty = F.array().cast("array<bigint>")
    return [F.coalesce(F.first(F.when(F.col("term") == t, F.col("postings")), ignorenulls=True), empty).alias(f"__{i}") for i, t in enumerate(wanted)]


def folded(node: Node, wanted: list[str]) -> Column:
    """The node as set operations on the columns of `lists_of`."""
    if isinstance(node, Term):
        return F.array_distinct(F.col(f"__{wanted.index(node.text)}"))
    return (F.array_intersect if node.name == "AND" else F.array_union)(folded(node.left, wanted), folded(node.right, wanted))


def search_lists(lists: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame:
    """The keys that match, by set operations on the posting lists of one row per term: for selective queries."""
    try:
        node = parse(query)
    except QueryError:
        return nothing(lists.select(F.explode("postings").alias(key)), key)
    wanted = terms(node)
    return lists.where(F.col("term").isin(wanted)).agg(*lists_of(wanted)).select(F.explode(folded(node, wanted)).alias(key))


def preview(found: DataFrame, key: str = "doc_id", k: int = 10) -> DataFrame:
    """The first k keys in order, each beside the number of all and of those not shown."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    first = found.orderBy(key).limit(k).crossJoin(F.broadcast(total))  # k rows by one row
    return first.select(key, "total", F.greatest(F.col("total") - k, F.lit(0).cast("long")).alias("more"))
