import pytest

from sparkloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_native_queries_have_no_python(spark):
    for name in ("op5_weighted_hash_tree", "op10_source_mixing"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
