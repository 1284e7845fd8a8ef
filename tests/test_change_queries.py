"""Each query over trees, versions, listings and merged sources against its SQL."""

import pytest

from gristmill import change_queries, process_queries, queries, stream_queries
from tests.test_queries import SF, duck, rows  # noqa: F401


SQL = change_queries.ORACLE_SQL | stream_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = (change_queries.QUERIES | stream_queries.QUERIES)[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(want.columns, want.fetchall()) and found


def test_names_are_not_taken_twice():
    every = [*queries.QUERIES, *process_queries.QUERIES, *change_queries.QUERIES, *stream_queries.QUERIES]
    assert len(every) == len(set(every))
