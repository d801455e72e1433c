import os

import pytest

from quillmere.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, assert_equal

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, name):
    if name in ORACLES:
        assert_equal(spark, QUERIES[name], ORACLES[name])
    else:  # these are held against brute force in their own tests
        assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op1_chat_format", "op6_decontaminate", "op7_quality_rules"])
def test_native_operators_use_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
