"""Plans hold what they should: pruned scans, one shuffle, no row-wise Python, no products."""

from __future__ import annotations

import pytest

from perfsieve.operators import splits, summary
from perfsieve.plans import proxies as P
from perfsieve.plans.queries import queries

SF_DIR = "/root/testdata/sf0.001"
SKIP = {"train_gbt_static", "train_gbt_ts", "train_gbt_hybrid", "cv_grid", "text_dataset"}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - SKIP))
def test_no_python_rows_and_no_products(spark, name):
    shown = plan(queries()[name](spark, SF_DIR))
    for operator in ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert operator not in shown, operator


def test_summary_takes_two_narrow_shuffles(spark):
    shown = plan(summary.aggregate_alerts(P.alerts(spark, SF_DIR)))
    # One for the statistics and one for the category profile, each pruned to its own columns.
    assert shown.count("Exchange hashpartitioning") == 2


def test_scan_reads_only_what_is_used(spark):
    lines = P.table(spark, SF_DIR, "lineitem").withColumnRenamed("l_orderkey", "alert_summary_id")
    shown = plan(summary.grouped_p90(lines, ["alert_summary_id"], ["l_tax"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in shown


def test_split_does_not_shuffle_the_table(spark):
    orders = P.table(spark, SF_DIR, "orders")
    assert "Exchange" not in plan(splits.time_split(orders, "o_orderdate", "o_orderkey"))
