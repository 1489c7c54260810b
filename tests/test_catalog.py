"""Every registered query against its SQL."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from linelens import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    mine = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    theirs = sorted(([norm(r[want.columns.index(c)]) for c in cols] for r in want.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, kind", [("License", "ngrams"), ("rights reserved", "ngrams"), ("éau", "ngrams"), ("ation", "scan"), ("th", "fragment"), ("qzx", "empty")])
def test_plan_kinds(spark, name, kind):
    """The registered searches take the paths that they are named for."""
    from linelens.plans.search import make_plan

    assert make_plan(catalog.index_of(spark, SF), name).kind == kind
