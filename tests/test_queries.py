"""Every query of the engine against its SQL at the smallest scale; those without SQL run and keep their schema."""

from __future__ import annotations

import pytest
from compare import FOLDER, same

from lodestone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is not None:
        same(spark, query, sql)
    else:
        frame = query(spark, FOLDER)
        assert frame.columns
        frame.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
