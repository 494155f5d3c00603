"""Every query of the catalog against its SQL."""

import pytest

from batchlake.plans import catalog
from conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    rows = same_rows(catalog.QUERIES[name](spark, SF), catalog.SQL[name])
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
