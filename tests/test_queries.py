"""Every registered query against its SQL, on the smallest tables."""

import pytest

from conftest import same_as_sql
from tessera.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    same_as_sql(registry.queries()[name](spark, sf), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "boost", "final"] and df.count() > 0


def test_scan_is_pruned(spark, sf):
    """Filters and columns reach the scan."""
    plan = registry.queries()["events_by_type"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
