import pytest

from stratacell import queries
from tests.conftest import same_as_duckdb

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same_as_duckdb(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
