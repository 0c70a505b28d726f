"""Every registered query gives the rows of its SQL."""

import pytest

from quaverlake import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(same, name):
    same(QUERIES[name], SQL[name])


def test_queries_without_sql_are_few():
    """Those are compared with plain versions in ``test_lists``, or by what they find."""
    assert set(QUERIES) - set(SQL) == {"all_but_the_top", "adventure_path", "contrastive_heads", "mix_routes", "radio_wave", "stream_radio_queues", "walk_reports"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
