"""Every registered engine query against its SQL twin; the others must run and give rows."""

import pytest
from oracle import compare, connect

from samplewright.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert compare(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.limit(1).count() == 1


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["condition", "mean_amplitude", "n"]
