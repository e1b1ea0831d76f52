"""Every registered query: its plan, and its rows against its SQL twin."""

import re

import pytest

import __spark_entry__ as driver
from goldsieve.plans.catalog import QUERIES


def _sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted((tuple(row[n] for n in order) for row in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, folder, duck, name):
    got = driver.queries()[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    wanted = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert _sorted_rows(got.collect(), got.columns) == _sorted_rows(wanted.fetchall(), names)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() == 15
