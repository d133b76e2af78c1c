"""Every query runs on whole tables; those with an oracle must match it exactly."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        ok, note = compare(df, duck, ORACLES[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["property"] for r in rows} == {"gross", "disc", "net", "tax", "charge"}
    exact = {r["property"]: r["r2"] for r in rows}
    assert exact["net"] == exact["charge"] == 1.0  # identities of the fixture
