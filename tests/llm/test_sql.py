"""Queries that SQL can express, against DuckDB."""

import pytest

from goldsieve.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, duck, name):
    wanted = duck.execute(ORACLES[name])
    names = [column[0] for column in wanted.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))
