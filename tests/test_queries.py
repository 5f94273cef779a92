"""Every registered query against its SQL on the smallest tables."""

import pytest

from colloquy.plans import catalog
from compare import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_query(name, spark, con, sf):
    status, note, _, _ = compare(spark, con, name, sf, catalog.PLANS, catalog.SQL)
    assert status in ("ok", "rows") or (status == "EMPTY" and name in catalog.SQL), note
    assert name in catalog.SQL or not note.startswith("0 rows")


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
