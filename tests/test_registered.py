import pytest

import __spark_entry__ as contract
from conftest import plan_text
from mixscore_checks.compare import connect, difference
from mixscore_checks.oracle import ORACLE
from mixscore_checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = plan_text(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not name.startswith("q14"):
        assert "Python" not in plan and "Arrow" not in plan
    assert difference(df, duck, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 200
