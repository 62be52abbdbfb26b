import pytest
from oracle import assert_same

from pagefold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_equals_its_sql(spark, small, name):
    assert_same(registry.queries()[name](spark, small), registry.sql()[name], small)


def test_every_sql_has_a_query():
    assert set(registry.sql()) <= set(registry.queries())


def test_entry_has_a_stable_schema(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:4] == ["page_idx", "doc_id", "family", "difficulty"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
