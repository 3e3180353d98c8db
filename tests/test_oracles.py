"""Every registered query of the library against its SQL; those without SQL must give rows twice alike."""

from __future__ import annotations

import pytest

from caseworks.plans import registry
from tests.compare import rows, sql_rows

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df)
    if name in SQL:
        names, want = sql_rows(SF, SQL[name])
        assert sorted(df.columns) == names
        assert got == want
    elif name != "p8_jitter":
        assert got == rows(registry.queries()[name](spark, SF))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
