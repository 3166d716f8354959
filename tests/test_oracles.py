"""Every query with SQL agrees with DuckDB; the others run and give rows."""

import pytest

from quillspark.plans import registry
from tests.oracle import SF_DIR, connection, of_frame, of_sql


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert of_frame(registry.QUERIES[name](spark, SF_DIR)) == of_sql(con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0
