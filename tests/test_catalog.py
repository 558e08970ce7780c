import pytest

from meterlake.plans.catalog import ORACLES, QUERIES

from .conftest import DATA
from .oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_price_spans_are_broadcast_and_filters_pushed(spark):
    from meterlake.operators.usage import Filter, totals
    from meterlake.plans.facts import usage_facts

    plan = totals(usage_facts(spark, DATA), Filter("2024-01-05 00:00:00", None, None))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
