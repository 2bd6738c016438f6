"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import connection, same_rows

from cairnmem import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLE_SQL:
        same_rows(df, con, plans.ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
