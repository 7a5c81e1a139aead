"""Every registered query outside the corpus operators, against its SQL where it has one."""

import pytest
from oracle import DATA, bag, expected

from shotlake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name in registry.ORACLES:
        assert bag(got) == bag(expected(registry.ORACLES[name], "sf0.001"))
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
