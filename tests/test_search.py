import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index
from tessera.plans import boolean
from tessera.plans.boolean import Op, QueryError, Term

DOCS = [(1, "apple banana"), (2, "banana orange"), (3, "apple orange"), (4, "plum"), (5, None), (6, "Кидаться apple")]


@pytest.fixture(scope="module")
def postings(spark):
    return index.postings(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", "text")


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("query,valid", [("a", 1), ("a AND b", 1), ("a or b", 1), ("(a OR b) AND c", 1), ("a OR b AND c", 1), ("AND a b", 1), ("a b AND", 1), ("a b", 0), ("()", 0), ("(a", 0), ("a)", 0), ("a AND", 0), ("", 0), (None, 0)])
def test_acceptance(query, valid):
    assert (boolean.error(query) is None) == bool(valid)


def test_precedence_and_grouping():
    a, b, c = Term("a"), Term("b"), Term("c")
    assert boolean.parse("a OR b AND c") == Op("OR", a, Op("AND", b, c))
    assert boolean.parse("(a OR b) AND c") == Op("AND", Op("OR", a, b), c)
    assert boolean.parse("a AND b AND c") == Op("AND", Op("AND", a, b), c)
    with pytest.raises(QueryError):
        boolean.parse("a b")


def test_terms_are_normalised_and_stemmed_only():
    assert boolean.analyze_term("NASA") == "nasa" and boolean.analyze_term("кидаться") == "кид"
    assert boolean.analyze_term("a-b") == "a-b" and boolean.analyze_term("foo,bar") == "foo bar" and boolean.analyze_term("и") == "и"


@pytest.mark.parametrize("query,want", [("apple AND orange", [3]), ("apple OR banana", [1, 2, 3, 6]), ("(apple OR banana) AND orange", [2, 3]), ("apple AND nothing", []), ("nothing OR plum", [4]), ("apple banana", []), ("a-b", []), ("AND apple orange", [3])])
def test_three_forms_agree(spark, postings, query, want, tmp_path):
    index.save_index(postings, "doc_id", str(tmp_path / "i"))
    saved = index.load_index(spark, str(tmp_path / "i"))
    assert ids(boolean.search_postings(postings, query)) == want
    assert ids(boolean.search_index(saved, query)) == want
    assert ids(boolean.search_lists(index.inverted_index(postings, "doc_id"), query)) == want


def test_random_queries_equal_sets(spark, postings):
    have: dict[str, set] = {}
    for term, doc in postings.collect():
        have.setdefault(term, set()).add(doc)
    rng = random.Random(5)

    def make(depth):
        if not depth or rng.random() < 0.3:
            t = rng.choice(["apple", "banana", "orange", "plum", "none"])
            return t, have.get(t, set())
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        return (f"({a} AND {b})", x & y) if rng.random() < 0.5 else (f"({a} OR {b})", x | y)

    for _ in range(8):
        query, want = make(3)
        assert ids(boolean.search_postings(postings, query)) == sorted(want)


def test_simplify_orders_by_frequency():
    node = boolean.parse("a AND (b OR x)")
    assert boolean.simplify(node, {"a": 9, "b": 1}) == Op("AND", Term("b"), Term("a"))
    assert boolean.simplify(node, {"a": 9}) is None


def test_blocks_split_long_lists(spark, postings):
    rows = index.posting_blocks(postings, "doc_id", block=2).where("term = 'apple'").orderBy("block").collect()
    assert [(r["block"], r["df"], r["postings"]) for r in rows] == [(0, 3, [1]), (1, 3, [3]), (3, 3, [6])]


def test_partitions_do_not_matter(spark, postings):
    one, many = (index.inverted_index(postings.repartition(n), "doc_id").orderBy("term").collect() for n in (1, 7))
    assert one == many


def test_index_lookups(spark, postings, tmp_path):
    path = str(tmp_path / "i")
    index.save_index(postings, "doc_id", path)
    saved = index.load_index(spark, path)
    assert ids(index.search_exact(saved, "apple")) == [1, 3, 6] and index.search_exact(saved, "Apple").count() == 0
    assert index.find_term(saved, "plum").collect()[0]["df"] == 1 and index.find_term(saved, "x").count() == 0
    plan = index.search_exact(saved, "apple")._jdf.queryExecution().toString()
    assert "EqualTo(term,apple)" in plan
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        index.load_index(spark, str(tmp_path / "x"))


def test_preview(spark):
    got = boolean.preview(spark.range(25).withColumnRenamed("id", "doc_id")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(10)) and got[0]["total"] == 25 and got[0]["more"] == 15


def test_empty_postings(spark, postings):
    assert boolean.search_postings(postings.where(F.lit(False)), "apple OR plum").count() == 0
