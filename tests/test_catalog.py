"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from check import compare, connect
from helpers import plan
from tremorlake.catalog import ORACLES, QUERIES

WRITES = ("a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "b8", "g", "h1b", "h2")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert name == "a14_storage_footprint" and df.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(WRITES)])
def test_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text, operator


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
