"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from tablesync.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE[name]) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark)
    assert out.count() == 1500 and out.columns[0] == "o_orderkey"


def _plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["incremental_delta", "latest_by_key", "write_merge", "cdc_apply", "reconcile_rows", "verify_key",
             "run_history", "run_status", "table_executions", "checkpoint_fold", "snapshot_chunks"]
)
def test_no_single_task_exchange(spark, name):
    plan = _plan(spark, name)
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_reconcile_is_one_aggregation(spark):
    plan = _plan(spark, "reconcile_rows")
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1
