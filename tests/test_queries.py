"""Every catalogue query against its SQL on the smallest tables."""

import pytest

import oracle
from vetrina.plans.catalog_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = oracle.of_frame(QUERIES[name](spark, oracle.SF))
    if name in ORACLES:
        assert got == oracle.of_sql(sql, ORACLES[name])
    else:
        assert got == oracle.of_frame(QUERIES[name](spark, oracle.SF)) and got[1]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["id", "score", "reasons", "place"] and found.count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
