"""Every registered query against its check SQL, on the smallest data."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as driver
from perfsieve.plans import queries as registered

SF_DIR = "/root/testdata/sf0.001"
# The training-data queries have tests of their own.
QUERIES, CHECKS = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_check(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, CHECKS[name]) is None


def test_entry_is_the_alert_summary(spark):
    frame = driver.entry(spark)
    assert frame.count() > 1000
    assert {"alert_summary_id", "bug_created", "signature_id__nunique"} <= set(frame.columns)


def test_driver_has_every_query():
    assert set(QUERIES) <= set(driver.queries()) and set(CHECKS) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) - set(CHECKS) == {
        "pca_embeddings",
        "train_gbt_static",
        "train_gbt_ts",
        "train_gbt_hybrid",
        "cv_grid",
        "text_dataset",
    }
