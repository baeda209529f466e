import pytest

from spikeframe.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_range_join_is_an_equi_join(spark, sf_dir):
    plan = QUERIES["psth"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_is_asked_for(spark, sf_dir):
    plan = QUERIES["time_filter_neuron"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan.split("ReadSchema")[1]
