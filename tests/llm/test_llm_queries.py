"""Every query of the package against its SQL on the smallest tables."""

import pytest
from colloquy.llm import catalog
from compare import compare, duck


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_query(name, spark, sf):
    status, note, _, _ = compare(spark, duck(sf), name, sf, catalog.PLANS, catalog.SQL)
    assert status == ("ok" if name in catalog.SQL else "rows"), note
    assert not note.startswith("0 rows")
