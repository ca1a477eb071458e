"""Plan properties that carry the scale design (checked on static plans)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def _plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_k_limits_before_the_shuffle(spark):
    p = _plan(spark, "limit_per_category")
    assert p.count("WindowGroupLimit") == 2          # partial below the exchange, final above


def test_row_choice_combines_map_side(spark):
    p = _plan(spark, "dedupe_keep_first")
    assert "partial_min_by" in p and p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["change_status_counts", "merge_catalog", "site_run_records", "label_topk_cosine",
                                  "page_walk_counts", "listing_dynamic", "page_sites"])
def test_no_nested_loop_joins(spark, name):
    p = _plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
