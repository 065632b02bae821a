import pytest

from leafmill.plans import rules  # noqa: F401  registers its queries
from leafmill.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(name, same_as_oracle):
    same_as_oracle(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["page_metadata", "page_articles", "natural_page_order"])
def test_query_without_an_oracle_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry_import(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
