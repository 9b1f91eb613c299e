"""Payments and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import as_double, exact_mean, percent, whole_days
from mercadia.functions.params import Period
from mercadia.plans.facts import orders_of
from mercadia.sources.shop import Shop


def payment_preferences(shop: Shop, period: Period) -> DataFrame:
    """Payments per type for orders of the period, most used first."""
    in_period = period.keep(orders_of(shop)).select("order_id")
    return (
        shop.payments.select("order_id", "payment_type")
        .join(in_period, "order_id")
        .groupBy("payment_type")
        .agg(F.count(F.lit(1)).alias("usage_count"))
        .orderBy(F.desc("usage_count"), "payment_type")
    )


def top_payment_type(shop: Shop, period: Period) -> DataFrame:
    return payment_preferences(shop, period).limit(1).select("payment_type")


def payment_shares(shop: Shop, period: Period) -> DataFrame:
    """Share of each payment type in percent."""
    used = payment_preferences(shop, period)
    total = used.agg(F.sum("usage_count")).scalar()
    return used.withColumn("share_pct", percent(F.col("usage_count"), total))


def payment_performance(shop: Shop) -> DataFrame:
    """Number and value of payments per type."""
    return (
        shop.payments.groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            as_double(F.sum("payment_value")).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "payment_type")
    )


def review_scores(shop: Shop) -> DataFrame:
    """Count and percentage of each score."""
    scores = shop.reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"))
    total = shop.reviews.agg(F.count(F.lit(1))).scalar()
    return scores.withColumn("percentage", percent(F.col("review_count"), total)).orderBy(
        F.desc_nulls_first("review_score")
    )


def review_response_time(shop: Shop) -> DataFrame:
    """Mean whole days from a review to its answer."""
    days = whole_days("review_creation_date", "review_answer_timestamp")
    return shop.reviews.agg(exact_mean(days).alias("avg_response_time"))
