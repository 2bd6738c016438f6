import pytest
from oracle import connection, same_rows

from cairnmem.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLE_SQL[name])
