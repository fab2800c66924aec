"""Every registered query of the raster and geometry operators against its SQL, or that it runs."""

import pytest

from pixelweft import catalog

from .compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert differences(spark, SMALL, query, sql) == ""
    else:
        assert query(spark, SMALL).columns
        query(spark, SMALL).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
