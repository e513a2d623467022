"""Every registered query against its SQL, or, without SQL, that it gives rows."""

import pytest

from lodestrata.plans import registry

from . import oracle

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    oracle.check(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["heat"] for r in rows] == sorted((r["heat"] for r in rows), reverse=True)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
