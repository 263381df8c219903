"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import norm

from mnemo.plans import catalog

NAMES = sorted(catalog.queries())
#: Queries that may find nothing on the smallest tables.
EMPTY = {"quality_fk", "sequential_dedupe", "leak_detector"}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)  # other tests recompute these
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want) and (len(got) or name in EMPTY)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
