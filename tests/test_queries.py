"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import SF, rows

from parlance.plans import jobs  # noqa: F401
from parlance.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect())
    assert set(e.oracle_sql()) <= set(e.queries())
