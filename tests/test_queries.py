"""Every query of the core against its SQL; those without SQL run and have rows of a stable schema."""

import pytest

from framemill.plans import registries
from tests.compare import connect, spark_rows, sql_rows

QUERIES = {n: (f, r.sql.get(n)) for r in registries() for n, f in r.queries.items()}


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data_dir, con, name):
    fn, sql = QUERIES[name]
    got = spark_rows(fn(spark, data_dir))
    if sql is not None:
        assert got == sql_rows(con, sql)
    else:
        assert got[0]


def test_entry(spark, data_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
