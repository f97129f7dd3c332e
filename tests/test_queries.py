"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 146
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_flagship_counts(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    assert QUERIES["bool_nested"](spark, "/root/testdata/sf0.01").count() == 798
    assert tuple(QUERIES["dictionary_size"](spark, "/root/testdata/sf0.01").first()) == (53176, 224052)


def test_rest_does_not_need_the_llm_package():
    """No module outside the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "tessera"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tessera\.llm|from \.+llm", p.read_text()), p
