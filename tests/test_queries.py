"""Every query that SQL can express gives what its SQL gives."""

import pytest

from attestry.plans import catalog
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["decision", "reasons"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
