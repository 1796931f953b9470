"""Every query of the catalog against its SQL."""

import pytest

from loomset.plans import catalog
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.SQL:
        assert_same(df, con, catalog.SQL[name])
    else:
        assert df.columns
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
