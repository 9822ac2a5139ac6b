"""Every query of the engine's own operators against its oracle SQL; those without are held against brute force elsewhere, and must repeat here."""

import pytest
from conftest import compare, table_of

from strandline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, small_data, name):
    df = registry.QUERIES[name](spark, small_data)
    if name in registry.ORACLES:
        compare(df, oracle, registry.ORACLES[name])
    else:
        once = table_of(df.columns, [tuple(r) for r in df.collect()])
        again = registry.QUERIES[name](spark, small_data)
        assert once[1] and len(set(df.columns)) == len(df.columns)
        assert once == table_of(again.columns, [tuple(r) for r in again.collect()])
