"""Stored facts give the same results as the base tables, and prune months."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mercadia.functions.params import Period
from mercadia.operators import customers, datasets, features, kpis, logistics, orders, products
from mercadia.plans import pipelines
from mercadia.registry import PERIOD
from mercadia.sources import versions, warehouse
from mercadia.sources.raw_csv import read_dataset
from mercadia.sources.sample_tables import sample_shop
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def base(spark):
    return sample_shop(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, base, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts"))
    warehouse.save_facts(base, path)
    return warehouse.with_facts(spark, base, path)


IN_PERIOD = (
    kpis.main_kpis,
    kpis.new_vs_returning_revenue,
    kpis.revenue_orders_trend,
    products.category_performance,
    products.category_return_rates,
    products.top_selling_products,
    orders.revenue_by_basket_size,
    orders.status_distribution,
    customers.spend_per_person,
    customers.repeat_customer_counts,
    customers.mean_days_between_orders,
    customers.top_categories_of,
    logistics.revenue_by_state,
    logistics.shipping_performance,
    logistics.delivery_breakdown,
)
OVER_ALL = (
    customers.customer_rfm,
    customers.churn_last_delivered,
    features.person_payment_types,
    features.person_category_counts,
    features.update_customers,
    features.update_products,
    features.purchase_documents,
    features.person_canceled_share,
)


def content(df):
    names = sorted(df.columns)
    return sorted(str([r[n] for n in names]) for r in df.collect())


@pytest.mark.parametrize("operator", IN_PERIOD, ids=lambda o: o.__name__)
def test_period_operators_agree(base, stored, operator):
    assert content(operator(base, PERIOD)) == content(operator(stored, PERIOD))


@pytest.mark.parametrize("operator", OVER_ALL, ids=lambda o: o.__name__)
def test_operators_over_all_history_agree(base, stored, operator):
    assert content(operator(base)) == content(operator(stored))


def test_series_agree(base, stored):
    for by in (None, "customer_state"):
        ours = datasets.sales_series(stored, "weekly", by=by)
        assert content(ours) == content(datasets.sales_series(base, "weekly", by=by))


def test_first_time_categories_agree(base, stored):
    for shop in (base, stored):
        assert customers.top_categories_of(shop, PERIOD, "first_time").count() > 0
    assert content(customers.top_categories_of(base, PERIOD, "first_time")) == content(
        customers.top_categories_of(stored, PERIOD, "first_time")
    )


def test_only_months_of_the_period_are_read(stored):
    quarter = Period.of_days(date(1997, 1, 1), date(1997, 3, 31))
    plan = kpis.main_kpis(stored, quarter)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
    months = quarter.keep(stored.order_fact).select("purchase_month").distinct().collect()
    assert {r[0].month for r in months} <= {1, 2, 3}


def test_bucketed_tables_join_without_a_shuffle(spark, base, tmp_path):
    database = "shop_bucket_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{tmp_path}/db'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warehouse.create_tables(spark, database, buckets=4)
        warehouse.load_tables(base, database, check=False, buckets=4)
        shop = warehouse.read_database(spark, database)
        trend = kpis.revenue_orders_trend(shop, PERIOD)
        assert content(trend) == content(kpis.revenue_orders_trend(base, PERIOD))
        plan = trend._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(order_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_feature_tables_and_datasets_are_written(spark, base, tmp_path):
    folder = pipelines.run_features(base, str(tmp_path), datetime(2001, 8, 1))
    store = spark.read.parquet(f"{tmp_path}/precomputed_features")
    names = {r[0] for r in store.select("feature_name").distinct().collect()}
    assert names == {"customer_product_purchases", "top_product_popularity", "customer_top_categories"}
    assert folder.endswith("version=20010801T000000")
    assert versions.read_current(spark, str(tmp_path), "customers").count() == base.customers.count()

    pipelines.run_datasets(base, f"{tmp_path}/ml")
    weekly = read_dataset(spark, f"{tmp_path}/ml/forecasting_dataset_weekly", "forecasting")
    trimmed = datasets.remove_outliers_log(datasets.sales_series(base, "weekly"), "y")
    assert content(weekly) == content(trimmed)
    segments = read_dataset(spark, f"{tmp_path}/ml/segmentation_dataset", "segmentation")
    assert segments.count() == base.customers.count()
    counts = read_dataset(spark, f"{tmp_path}/ml/recommendation_dataset", "recommendation")
    assert counts.agg(F.sum("purchase_count")).first()[0] > 0
