"""Every registered query with SQL gives the SQL's rows; the others run and have rows."""

import pytest
from conftest import same

from tracemill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, small, duck, name):
    same(registry.QUERIES[name](spark, small), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
