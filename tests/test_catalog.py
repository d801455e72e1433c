import os

import pytest

import __spark_entry__
from quillmere import catalog
from tests.oracle import DATA, assert_equal

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    if name in catalog.ORACLES:
        assert_equal(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
