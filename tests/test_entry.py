"""The driver's contract on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vectide import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(frame) -> list[str]:
    cols = sorted(frame.columns)
    return sorted(str(tuple(r)) for r in frame[cols].itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck().sql(sql).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert shown(got) == shown(want)
    else:
        assert len(got)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "vectide")
    for folder, _, files in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "vectide.llm" not in open(os.path.join(folder, f)).read()
