import pytest

from sightline.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, twin_dir, name):
    assert same(queries.QUERIES[name](spark, twin_dir), queries.SQL[name], twin_dir) > 0
