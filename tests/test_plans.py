"""What the plans must and must not contain, at the size where nothing is broadcast."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver
from mercadia.operators import customers, features, kpis, orders
from mercadia.registry import PERIOD, all_queries
from mercadia.sources.sample_tables import sample_shop
from tests.conftest import SMALL

# These fit a model while the query is built.
FITTED = {n for n in all_queries() if n.startswith("segment_") and n != "segment_summary_by_rule"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - FITTED))
def test_no_cross_join_and_no_global_window(unbroadcast, name):
    text = plan(driver.queries()[name](unbroadcast, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window \[.*\], \[\]", text), "window without partition"
    assert "BroadcastExchange" not in text, "nothing is sent everywhere by force"


def test_period_and_columns_reach_the_scan(spark):
    text = orders.status_distribution(sample_shop(spark, SMALL), PERIOD)
    scan = text._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in scan or "GreaterThanOrEq" in scan
    assert "o_totalprice" not in scan


def test_unused_joins_disappear(spark):
    shop = sample_shop(spark, SMALL)
    text = plan(orders.orders_over_time(shop, PERIOD))
    assert "lineitem" not in text
    assert "nation" not in plan(kpis.main_kpis(shop, PERIOD))


def test_first_rows_are_pruned_before_the_shuffle(spark):
    text = plan(driver.queries()["clean_customers"](spark, SMALL))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_items_are_added_up_before_they_are_joined(unbroadcast):
    text = plan(kpis.main_kpis(sample_shop(unbroadcast, SMALL), PERIOD))
    join = text.index("SortMergeJoin [order_id")
    assert "partial_sum" in text[join:]


def test_gap_window_sees_days_not_orders(spark):
    text = plan(features.order_gaps(sample_shop(spark, SMALL), delivered_only=True, single_order_default=0))
    window = text.index("Window [")
    assert re.search(r"HashAggregate\(keys=\[customer_unique_id#\d+L, day", text[window:])


def test_no_window_for_first_orders_and_mean_gaps(spark):
    shop = sample_shop(spark, SMALL)
    for df in (kpis.new_vs_returning_revenue(shop, PERIOD), customers.mean_days_between_orders(shop, PERIOD)):
        assert "Window" not in plan(df)


def test_top_n_is_not_a_full_sort(spark):
    shop = sample_shop(spark, SMALL)
    text = plan(customers.top_categories_of(shop, PERIOD, "repeat"))
    assert "TakeOrderedAndProject" in text
