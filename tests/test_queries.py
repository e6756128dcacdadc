"""The registry: every query against its SQL on the smallest tables, and what no plan may hold."""

import pytest

import __spark_entry__ as E
from tests.check_oracle import check, duck
from workload import oracle, registry

SF = "/root/testdata/sf0.001"
WRITES = {
    "typed_table", "refresh_twice", "streamed_table", "stored_sample", "hash_export", "live_totals", "live_totals_retries",
    "stored_sample_by_key", "store_damaged", "refresh_replaced", "refresh_failed", "stream_new_checkpoint",
    "open_by_suffix", "file_tree_audit", "survey_bad_date", "columns_by_header", "refresh_in_compaction",
    "streamed_changes", "file_tree_unreadable", "survey_incremental", "dist_incremental", "live_verdict_changes",
    "sample_from_summaries",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(E.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    assert check(spark, con, name, SF) is None


def test_entry(spark):
    assert E.entry(spark).count() == 5


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in WRITES])
def test_plan(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas", "Scan ExistingRDD"):
        assert node not in plan
    # a window or sort over everything would run in one task; an aggregate's last step may
    above: list[str] = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [x for x in above if x[0] < depth]
        if "Exchange SinglePartition" in line:
            assert not any(n.startswith(("Window", "Sort")) for _, n in above[-2:]), plan
        above.append((depth, line.lstrip(" :+-*()0123456789")))
