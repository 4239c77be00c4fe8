"""Plans that would hold at scale: no nested loops or cross joins, pruned scans, pushed filters, hash-friendly attribution."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tradelake.operators import lifecycle
from tradelake.plans.catalog import QUERIES
from tradelake.sources import driver

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_quadratic_join(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_scan_is_pruned_and_filtered(spark):
    df = driver.read(spark, DIR, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_interval_join_is_an_equality_join(spark):
    text = plan(lifecycle.attribute(driver.trades(spark, DIR), driver.deployments(spark, DIR)))
    assert "HashJoin" in text or "SortMergeJoin" in text


@pytest.mark.parametrize("name", ["trade_fold", "exit_vwap", "outcome_label", "segment_stats", "wilson_ci", "version_compare"])
def test_deals_are_aggregated_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    assert "partial_" in text and "Window" not in text


@pytest.mark.parametrize("name", ["rsi14", "atr14", "adx14", "roc10", "swings", "market_structure", "order_blocks", "fvg", "recent_range", "relative_volatility", "bars_gaps", "liquidity", "equity_drawdown", "terminal_gaps", "reentry_link", "reentry_chain", "pending_queue", "deployment_ambiguity"])
def test_no_task_holds_a_whole_series(spark, name):
    """Each window is over pieces of a symbol's series, or over one row for each piece or day."""
    df = QUERIES[name](spark, DIR)
    for spec in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString()):
        assert re.search(r"_p#|_t#|_day#", spec), spec


@pytest.mark.parametrize("name", ["asof_next", "news_proximity", "trade_dna"])
def test_no_frame_runs_to_the_end_of_its_piece(spark, name):
    """Such a frame is read anew for each row, so its cost is the square of the piece."""
    assert "unboundedfollowing" not in QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_distributions_run_over_batches(spark):
    """No fold over an array of steps, which Spark interprets row by row."""
    text = plan(QUERIES["small_sample_tests"](spark, DIR))
    assert "ArrowEvalPython" in text and "lambdafunction" not in text
