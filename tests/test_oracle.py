"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as registry
from tests.compare import difference, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


OWN = [name for name in registry.queries() if name not in registry.CORPUS_QUERIES]


def test_every_query_has_sql():
    own = set(registry.queries()) - set(registry.CORPUS_QUERIES)
    assert own <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert difference(df, oracle, registry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0
