"""Every registered query of the library gives the rows of its SQL."""

from __future__ import annotations

import pytest
from compare import by_spark, by_sql, same

from tidemark import registry


def test_every_query_is_named_once():
    assert registry.QUERIES
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    names, mine = by_spark(registry.QUERIES[name](spark, sf_dir))
    if name not in registry.SQL:
        assert mine
        return
    sql_names, theirs = by_sql(registry.SQL[name], sf_dir)
    assert names == sql_names
    assert same(mine, theirs)
