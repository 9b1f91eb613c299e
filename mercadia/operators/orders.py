"""Order dynamics: volumes, statuses, basket sizes, busy hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, count_where, percent, period_start, ratio
from mercadia.functions.params import PURCHASE, Period
from mercadia.plans.facts import delivered, orders_of
from mercadia.sources.shop import Shop

# Day names, Sunday is 0.
DAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def orders_over_time(shop: Shop, period: Period, granularity: str = "month") -> DataFrame:
    """Delivered orders per day, week, month, quarter or year."""
    return (
        period.keep(delivered(orders_of(shop)))
        .groupBy(period_start(granularity, PURCHASE).alias("time_period"))
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy("time_period")
    )


def status_distribution(shop: Shop, period: Period) -> DataFrame:
    """Orders per status, most frequent first."""
    return (
        period.keep(orders_of(shop))
        .groupBy("order_status")
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy(F.desc("total_orders"), "order_status")
    )


def most_frequent_open_status(shop: Shop, period: Period) -> DataFrame:
    """The most common status besides delivered and canceled."""
    open_orders = period.keep(orders_of(shop)).filter(
        (F.col("order_status") != "delivered") & (F.col("order_status") != "canceled")
    )
    return (
        open_orders.groupBy("order_status")
        .agg(F.count("order_id").alias("status_count"))
        .orderBy(F.desc("status_count"), "order_status")
        .limit(1)
    )


def revenue_by_basket_size(shop: Shop, period: Period) -> DataFrame:
    """Revenue of delivered orders by their number of items."""
    return (
        period.keep(delivered(orders_of(shop, totals=True)))
        .groupBy(F.col("item_count").alias("items_per_order"))
        .agg(amount(F.sum("revenue_cents")).alias("total_revenue_from_order_size"))
        .orderBy("items_per_order")
    )


def average_items_per_order(shop: Shop, period: Period) -> DataFrame:
    return period.keep(delivered(orders_of(shop, totals=True))).agg(
        ratio(F.sum("item_count"), F.count("item_count")).alias("avg_items_per_order"),
        F.count("order_id").alias("total_orders_for_avg_items"),
    )


def order_date_range(shop: Shop) -> DataFrame:
    """First and last purchase date."""
    return orders_of(shop).agg(
        F.min(PURCHASE).cast("date").alias("min_date"), F.max(PURCHASE).cast("date").alias("max_date")
    )


def peak_order_times(shop: Shop, period: Period) -> DataFrame:
    """Orders of any status per weekday (Sunday is 0) and hour."""
    return (
        period.keep(orders_of(shop))
        .groupBy(
            (F.dayofweek(PURCHASE) - 1).cast("bigint").alias("day_of_week"),
            F.hour(PURCHASE).cast("bigint").alias("hour_of_day"),
        )
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy("day_of_week", "hour_of_day")
    )


def peak_slot(shop: Shop, period: Period) -> DataFrame:
    """The busiest weekday and hour; the earliest slot wins a tie."""
    names = F.array(*(F.lit(d) for d in DAY_NAMES))
    return (
        peak_order_times(shop, period)
        .orderBy(F.desc("total_orders"), "day_of_week", "hour_of_day")
        .limit(1)
        .select(
            F.get(names, F.col("day_of_week").cast("int")).alias("day_name"),
            "hour_of_day",
            "total_orders",
        )
    )


def order_heatmap(shop: Shop, period: Period) -> DataFrame:
    """Hours down, weekdays across, every weekday present, 0 where nothing was ordered."""
    grid = (
        peak_order_times(shop, period)
        .groupBy("hour_of_day")
        .pivot("day_of_week", list(range(7)))
        .agg(F.sum("total_orders"))
        .na.fill(0)
    )
    return grid.select(
        "hour_of_day", *(F.col(str(i)).alias(name) for i, name in enumerate(DAY_NAMES))
    ).orderBy("hour_of_day")


def canceled_share_of_orders(shop: Shop) -> DataFrame:
    """Canceled orders in percent of all orders."""
    return orders_of(shop).agg(
        percent(count_where(F.col("order_status") == "canceled"), F.count(F.lit(1))).alias(
            "estimated_return_rate"
        )
    )


def canceled_against_delivered(shop: Shop) -> DataFrame:
    """Canceled orders in percent of delivered orders."""
    has_id = F.col("order_id").isNotNull()
    return orders_of(shop).agg(
        percent(
            count_where((F.col("order_status") == "canceled") & has_id),
            count_where((F.col("order_status") == "delivered") & has_id),
        ).alias("estimated_return_rate")
    )
