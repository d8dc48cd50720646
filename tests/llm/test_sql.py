"""Every numbered operator with SQL gives the rows of its SQL."""

from __future__ import annotations

import pytest
from compare import by_spark, by_sql, same

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    names, mine = by_spark(queries.QUERIES[name](spark, sf_dir))
    sql_names, theirs = by_sql(queries.SQL[name], sf_dir)
    assert names == sql_names
    assert mine
    assert same(mine, theirs)
