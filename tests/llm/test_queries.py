"""Queries of the sub-package against their SQL, or with rows where there is none."""

import pytest

from framemill.llm.queries import R
from tests.compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", R.queries)
def test_query(spark, data_dir, con, name):
    got = spark_rows(R.queries[name](spark, data_dir))
    if name in R.sql:
        assert got == sql_rows(con, R.sql[name])
    else:
        assert got[0]
