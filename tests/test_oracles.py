import pytest

import sightline.registry as registry
from tests.oracle import same

registry.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_duckdb(spark, twin_dir, name):
    assert same(registry.QUERIES[name](spark, twin_dir), registry.SQL[name], twin_dir) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
