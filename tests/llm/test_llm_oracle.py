"""Every corpus query with SQL gives its rows."""

import pytest

from quaverlake.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(same, name):
    same(registry.queries()[name], SQL[name])
