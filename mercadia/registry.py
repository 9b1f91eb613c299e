"""Every operator by name, bound to the sample tables and fixed parameters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.params import Period
from mercadia.operators import (
    cleaning,
    customers,
    datasets,
    features,
    forecast,
    kpis,
    logistics,
    orders,
    payments,
    products,
    quality,
    segments,
)
from mercadia.plans import facts
from mercadia.plans.checkpoints import cut_lineage
from mercadia.plans.quantiles import exact_quantiles
from mercadia.sources import sample_tables as sample
from mercadia.sources.sample_tables import SampleTables, event_shop, faulty_shop, sample_shop
from mercadia.sources.shop import Shop
from mercadia.sources.sql import run_query

Query = Callable[[SparkSession, str], DataFrame]

PERIOD = Period.of_days(date(1996, 1, 1), date(2000, 12, 31))
EVENT_PERIOD = Period.of_days(date(2024, 1, 1), date(2024, 12, 31))
COMPUTED_AT = datetime(2001, 8, 1)


def _on(make_shop: Callable[[SparkSession, str], Shop], operator: Callable[..., DataFrame], *args, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(make_shop(spark, sf_dir), *args, **options)

    return query


def _business_health() -> dict[str, Query]:
    on = partial(_on, sample_shop)
    return {
        "main_kpis": on(kpis.main_kpis, PERIOD),
        "kpis_against_previous": on(kpis.kpis_against_previous, PERIOD),
        "kpis_first_ever": on(kpis.kpis_first_ever, PERIOD),
        "gross_margin": on(kpis.gross_margin, PERIOD),
        "new_customer_rate": on(kpis.new_customer_rate, PERIOD),
        "revenue_orders_trend_month": on(kpis.revenue_orders_trend, PERIOD, "ME"),
        "revenue_orders_trend_year": on(kpis.revenue_orders_trend, PERIOD, "YE"),
        "revenue_orders_trend_day": on(kpis.revenue_orders_trend, PERIOD, "D"),
        "aov_trend": on(kpis.aov_trend, PERIOD),
        "new_vs_returning_revenue": on(kpis.new_vs_returning_revenue, PERIOD),
        "revenue_over_time": on(kpis.monthly_price_revenue, PERIOD),
        "revenue_trend_all_history": on(kpis.monthly_price_revenue),
        "average_order_value": on(kpis.average_order_value),
        "average_shipping_cost": on(kpis.average_shipping_cost),
        "shipping_cost_per_item": on(kpis.average_shipping_cost),
    }


def _products() -> dict[str, Query]:
    on = partial(_on, sample_shop)
    return {
        "category_performance": on(products.category_performance, PERIOD),
        "category_return_rates": on(products.category_return_rates, PERIOD),
        "category_matrix": on(products.category_matrix, PERIOD),
        "top_categories": on(products.top_categories, PERIOD),
        "category_ranking_revenue": on(products.category_ranking, PERIOD, "total_revenue"),
        "category_ranking_units": on(products.category_ranking, PERIOD, "total_units_sold"),
        "top_return_rates": on(products.top_return_rates, PERIOD),
        "top_selling_products": on(products.top_selling_products, PERIOD, 10),
        "top_selling_categories": on(products.top_selling_categories),
    }


def _orders() -> dict[str, Query]:
    on, at = partial(_on, sample_shop), partial(_on, event_shop)
    volumes = {
        f"orders_over_time_{unit}": on(orders.orders_over_time, PERIOD, unit)
        for unit in ("day", "week", "month", "quarter", "year")
    }
    return volumes | {
        "status_distribution": on(orders.status_distribution, PERIOD),
        "most_frequent_open_status": on(orders.most_frequent_open_status, PERIOD),
        "revenue_by_basket_size": on(orders.revenue_by_basket_size, PERIOD),
        "average_items_per_order": on(orders.average_items_per_order, PERIOD),
        "order_date_range": on(orders.order_date_range),
        "peak_order_times": at(orders.peak_order_times, EVENT_PERIOD),
        "peak_slot": at(orders.peak_slot, EVENT_PERIOD),
        "order_heatmap": at(orders.order_heatmap, EVENT_PERIOD),
        "canceled_share_of_orders": on(orders.canceled_share_of_orders),
        "canceled_against_delivered": on(orders.canceled_against_delivered),
    }


def _customers() -> dict[str, Query]:
    on = partial(_on, sample_shop)
    return {
        "spend_per_person": on(customers.spend_per_person, PERIOD),
        "mean_spend": on(customers.mean_spend, PERIOD),
        "spend_histogram": on(customers.spend_histogram, PERIOD),
        "repeat_customer_counts": on(customers.repeat_customer_counts, PERIOD),
        "repeat_rate": on(customers.repeat_rate, PERIOD),
        "repeat_purchase_rate": on(customers.repeat_purchase_rate),
        "mean_days_between_orders": on(customers.mean_days_between_orders, PERIOD),
        "top_categories_of_repeat": on(customers.top_categories_of, PERIOD, "repeat"),
        "top_categories_of_first_time": on(customers.top_categories_of, PERIOD, "first_time"),
        "customer_rfm": on(customers.customer_rfm),
        "lifetime_value": on(customers.lifetime_value),
        "churn_any_old_order": on(customers.churn_any_old_order),
        "churn_last_delivered": on(customers.churn_last_delivered),
        "payment_preferences": on(payments.payment_preferences, PERIOD),
        "top_payment_type": on(payments.top_payment_type, PERIOD),
        "payment_shares": on(payments.payment_shares, PERIOD),
        "payment_performance": on(payments.payment_performance),
        "payment_method_performance": on(payments.payment_performance),
        "review_scores": on(payments.review_scores),
        "customer_satisfaction": on(payments.review_scores),
        "review_response_time": on(payments.review_response_time),
    }


def _logistics() -> dict[str, Query]:
    on = partial(_on, sample_shop)
    return {
        "revenue_by_state": on(logistics.revenue_by_state, PERIOD),
        "revenue_by_state_of_region": on(logistics.revenue_by_state, PERIOD, "NATION_7"),
        "shipping_performance": on(logistics.shipping_performance, PERIOD),
        "shipping_punctuality": on(logistics.shipping_punctuality, PERIOD),
        "delivery_breakdown": on(logistics.delivery_breakdown, PERIOD),
        "delivery_stages": on(logistics.delivery_stages, PERIOD),
        "delivery_times_by_state": on(logistics.delivery_times_by_state, PERIOD),
        "delivery_against_estimate": on(logistics.delivery_against_estimate),
    }


def _features() -> dict[str, Query]:
    on = partial(_on, sample_shop)

    def updated_column(name: str) -> Query:
        return on(lambda shop: features.update_customers(shop).select("customer_id", name))

    def trimmed(shop: Shop, frequency: str) -> DataFrame:
        return datasets.remove_outliers_log(datasets.sales_series(shop, frequency), "y")

    def priced(shop: Shop) -> DataFrame:
        return facts.with_category(shop, _plain(shop.order_items.select("order_id", "order_item_id", "product_id", "price")))

    def price_quartiles(shop: Shop, by_category: bool = False) -> DataFrame:
        by = [facts.CATEGORY] if by_category else []
        found = exact_quantiles(priced(shop), "price", (0.25, 0.5, 0.75), by)
        quartiles = (F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3")))
        return found.select(*by, *quartiles)

    def trimmed_prices(shop: Shop) -> DataFrame:
        kept = datasets.remove_outliers_log(priced(shop), "price", by=[facts.CATEGORY], unbounded=True)
        return kept.select("order_id", "order_item_id", "product_id", "price")

    updates = {
        f"update_customers_{name}": updated_column(name)
        for name in (
            "clv",
            "avg_days_between_orders",
            "total_orders",
            "avg_order_value",
            "avg_shipping_cost",
            "estimated_return_rate",
        )
    }
    series = {f"sales_series_{f}": on(datasets.sales_series, f) for f in datasets.SERIES}
    series |= {f"sales_series_{f}_trimmed": on(trimmed, f) for f in datasets.SERIES}
    return updates | series | {
        "days_since_last_purchase": on(features.days_since_last_purchase),
        "order_gaps_all": on(features.order_gaps, delivered_only=False, single_order_default=9999),
        "order_gaps_delivered": on(features.order_gaps, delivered_only=True, single_order_default=0),
        "order_frequency": on(features.order_frequency),
        "person_order_value": on(features.person_order_value),
        "person_mean_price": on(features.person_mean_price),
        "person_payment_types": on(features.person_payment_types),
        "preferred_payment_types": on(features.preferred_payment_types),
        "person_mean_freight": on(features.person_mean_freight),
        "person_canceled_share": on(features.person_canceled_share),
        "order_values": on(features.order_values),
        "update_customers": on(features.update_customers),
        "purchase_documents": on(features.purchase_documents),
        "update_customers_product_purchases": on(features.customer_purchase_documents),
        "update_products_popularity": on(
            lambda shop: features.update_products(shop).select("product_id", "popularity_score")
        ),
        "update_orders_total_order_value": on(
            lambda shop: features.update_orders(shop).select("order_id", "total_order_value")
        ),
        "person_product_counts": on(features.person_product_counts),
        "product_popularity": on(features.product_popularity),
        "person_category_counts": on(features.person_category_counts),
        "precomputed_features": on(features.precomputed_features, COMPUTED_AT),
        "sales_series_weekly_by_state": on(
            datasets.sales_series, "weekly", by="customer_state"
        ),
        "sales_series_levels": on(datasets.sales_series_levels),
        "sales_series_level_totals": on(lambda shop: datasets.level_totals(datasets.sales_series_levels(shop))),
        "product_popularity_ranked": on(features.ranked_product_popularity),
        "price_quartiles": on(price_quartiles),
        "price_quartiles_by_category": on(price_quartiles, True),
        "item_prices_trimmed": on(trimmed_prices),
        "segmentation_dataset": on(datasets.segmentation_dataset),
        "segmentation_dataset_by_person": on(datasets.segmentation_dataset, "person"),
        "recommendation_dataset": on(datasets.recommendation_dataset),
    }


def _by_rule(shop: Shop) -> DataFrame:
    """Customers in segments by number of orders, a rule that SQL can check."""
    orders_placed = F.col("total_orders")
    rule = F.when(orders_placed < 5, 0).when(orders_placed < 9, 1).otherwise(2)
    rows = datasets.segmentation_dataset(shop).na.drop(subset=["clv", "total_orders"])
    return cut_lineage(rows.withColumn("segment", rule))


def _rounded(df: DataFrame) -> DataFrame:
    """Floating-point sums of double features differ in the last digits between runs."""
    return df.select(
        *(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes)
    )


def _plain(df: DataFrame) -> DataFrame:
    """Decimal columns as double, the form in which results leave the engine."""
    return df.select(
        *(F.col(c).cast("double") if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes)
    )


def _segments() -> dict[str, Query]:
    on = partial(_on, sample_shop)
    pair = ("clv", "avg_shipping_cost")

    def standardised(shop: Shop) -> DataFrame:
        rows = segments.standardise(features.update_customers(shop))
        return _rounded(rows.select("customer_id", *(f"z_{f}" for f in segments.FEATURES)))

    def feature_rows(shop: Shop) -> DataFrame:
        return cut_lineage(datasets.segmentation_dataset(shop))

    def scores(shop: Shop) -> DataFrame:
        rows = feature_rows(shop)
        return segments.segment_scores(segments.fit_segments(rows), rows)

    def segmented(shop: Shop, keep: bool = True) -> DataFrame:
        return segments.segment_customers(feature_rows(shop), keep_unclustered=keep)

    def split(shop: Shop) -> DataFrame:
        rows = segmented(shop).groupBy(F.col("segment").isNotNull().alias("clustered"))
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(facts.PERSON).alias("persons"))

    return {
        "standardise": on(standardised),
        "segment_customers": on(segmented),
        "segment_customers_clustered": on(segmented, False),
        "segment_scores": on(scores),
        "segment_centres": on(lambda shop: segments.segment_centres(segmented(shop, False))),
        "segment_summary": on(lambda shop: segments.segment_summary(segmented(shop, False))),
        "segment_summary_by_rule": on(lambda shop: _rounded(segments.segment_summary(_by_rule(shop)))),
        "clustering_scores": on(lambda shop: _rounded(segments.clustering_scores(_by_rule(shop), pair))),
        "silhouette_on_sample": on(lambda shop: _rounded(segments.silhouette_on_sample(_by_rule(shop), pair))),
        "segment_members": on(lambda shop: _rounded(segments.nearest_members(_by_rule(shop), facts.PERSON, pair))),
        "segment_split": on(split),
        "segment_model_centres": on(lambda shop: segments.model_centres(segments.fit_segments(feature_rows(shop)))),
        "calinski_harabasz": on(lambda shop: _rounded(segments.calinski_harabasz(_by_rule(shop), pair))),
        "davies_bouldin": on(lambda shop: _rounded(segments.davies_bouldin(_by_rule(shop), pair))),
    }


def _forecasts() -> dict[str, Query]:
    on = partial(_on, sample_shop)

    def state_series(shop: Shop) -> DataFrame:
        return datasets.sales_series(shop, "weekly", by="customer_state")

    def levels(shop: Shop) -> DataFrame:
        return datasets.sales_series_levels(shop, ("weekly", "daily"))

    def all_levels(shop: Shop) -> DataFrame:
        # One grouped fit for the shop, its states, its categories and their pairs.
        series = cut_lineage(levels(shop).select("series_id", "ds", "y"))
        return forecast.forecast(datasets.remove_outliers_log(series, "y", by=["series_id"]))

    def given(shop: Shop) -> DataFrame:
        """Forecasts that SQL can make, in the place of the models'."""
        marked = forecast.train_test_split(state_series(shop))
        naive = forecast.last_value_forecast(marked).withColumnRenamed("last_value", "arima")
        line = forecast.linear_trend_forecast(marked).select("series_id", "ds", F.col("linear_trend").alias("seasonal"))
        return forecast.ensemble(naive.join(line, ["series_id", "ds"]))

    def test_rows(shop: Shop) -> DataFrame:
        marked = forecast.train_test_split(levels(shop).select("series_id", "ds", "y"))
        return marked.filter("is_test").drop("is_test")

    def by_state(shop: Shop) -> DataFrame:
        trimmed = datasets.remove_outliers_log(state_series(shop), "y", by=["series_id"])
        return forecast.forecast(trimmed)

    def naive_metrics(shop: Shop) -> DataFrame:
        naive = forecast.last_value_forecast(forecast.train_test_split(state_series(shop)))
        return _rounded(forecast.compute_metrics(naive, "y", "last_value", ("series_id",)))

    def trend_metrics(shop: Shop) -> DataFrame:
        line = forecast.linear_trend_forecast(forecast.train_test_split(state_series(shop)))
        return _rounded(forecast.compute_metrics(line, "y", "linear_trend", ("series_id",)))

    return {
        "metrics_of_linear_trend": on(trend_metrics),
        "train_test_split": on(lambda shop: forecast.train_test_split(state_series(shop))),
        "metrics_of_last_value": on(naive_metrics),
        "forecast_test_rows": on(test_rows),
        "ensemble_of_baselines": on(lambda shop: _rounded(given(shop))),
        "metrics_of_baselines": on(lambda shop: _rounded(forecast.forecast_metrics(given(shop)))),
        "forecast_sales": on(all_levels),
        "forecast_metrics": on(lambda shop: forecast.forecast_metrics(all_levels(shop))),
        "forecast_sales_by_state": on(by_state),
        "forecast_metrics_by_state": on(lambda shop: forecast.forecast_metrics(by_state(shop))),
    }


def _cleaning() -> dict[str, Query]:
    def on(operator: Callable[..., DataFrame], *raw_tables: Callable[[SampleTables], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            table = SampleTables(spark, sf_dir)
            return operator(*(raw(table) for raw in raw_tables))

        return query

    at = partial(_on, faulty_shop)

    def zip_codes(shop: Shop) -> DataFrame:
        return cleaning.fix_missing_zip_codes(shop.geolocation, shop.customers, shop.sellers)

    def cascaded(shop: Shop) -> DataFrame:
        kept = quality.cascade(shop).order_items
        return kept.select("order_id", "order_item_id", "product_id", "seller_id")

    return {
        "clean_customers": on(cleaning.clean_customers, sample.raw_customers),
        "clean_products": on(cleaning.clean_products, sample.raw_products, sample.raw_translation),
        "clean_orders": on(cleaning.clean_orders, sample.raw_orders),
        "clean_order_items": on(cleaning.clean_order_items, sample.raw_order_items),
        "clean_reviews": on(cleaning.clean_reviews, sample.raw_reviews),
        "clean_geolocation": on(cleaning.clean_geolocation, sample.raw_geolocation),
        "clean_payments": _on(sample_shop, lambda shop: _plain(cleaning.passed_through(shop.payments))),
        "clean_sellers": _on(sample_shop, lambda shop: cleaning.passed_through(shop.sellers)),
        "fix_missing_zip_codes": _on(sample_shop, zip_codes),
        "key_report": _on(sample_shop, quality.key_report),
        "orphan_report": at(quality.orphan_report),
        "cascade_order_items": at(cascaded),
        "score_violations": on(quality.score_violations, sample.raw_scores),
        "width_report": at(quality.width_report),
    }


def _facts() -> dict[str, Query]:
    on = partial(_on, sample_shop)

    def parameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = """
            SELECT order_status, count(order_id) AS total_orders FROM {orders}
            WHERE order_purchase_timestamp BETWEEN :start_date AND :end_date
            GROUP BY order_status
        """
        bounds = {"start_date": PERIOD.start, "end_date": PERIOD.end}
        return run_query(spark, sample_shop(spark, sf_dir), text, bounds)

    return {
        "parameterised_sql": parameterised,
        "order_fact": on(lambda shop: _plain(facts.build_order_fact(shop))),
        "sales_fact": on(lambda shop: _plain(facts.build_sales_fact(shop))),
    }


def _over_facts() -> dict[str, Query]:
    """Operators that read the order and sales facts instead of the base tables."""

    def fact_shop(spark: SparkSession, sf_dir: str) -> Shop:
        shop = sample_shop(spark, sf_dir)
        return shop.but(order_fact=facts.build_order_fact(shop), sales_fact=facts.build_sales_fact(shop))

    on = partial(_on, fact_shop)
    return {
        "main_kpis_of_facts": on(kpis.main_kpis, PERIOD),
        "revenue_orders_trend_month_of_facts": on(kpis.revenue_orders_trend, PERIOD, "ME"),
        "new_vs_returning_revenue_of_facts": on(kpis.new_vs_returning_revenue, PERIOD),
        "category_performance_of_facts": on(products.category_performance, PERIOD),
        "delivery_breakdown_of_facts": on(logistics.delivery_breakdown, PERIOD),
        "update_customers_of_facts": on(features.update_customers),
    }


def all_queries() -> dict[str, Query]:
    groups = (
        _business_health,
        _products,
        _orders,
        _customers,
        _logistics,
        _features,
        _segments,
        _forecasts,
        _cleaning,
        _facts,
        _over_facts,
    )
    found: dict[str, Query] = {}
    for group in groups:
        found |= group()
    return found
