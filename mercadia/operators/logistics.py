"""Geography and delivery times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import (
    SECONDS_PER_DAY,
    amount,
    exact_mean,
    ratio,
    seconds_between,
    whole_days,
)
from mercadia.functions.params import PURCHASE, Period
from mercadia.plans.facts import STATE, delivered, orders_of, roll_up
from mercadia.sources.shop import Shop

# Stage of a delivery: (output column, from, to).
STAGES = (
    ("avg_payment_processing_time", PURCHASE, "order_approved_at"),
    ("avg_seller_handling_time", "order_approved_at", "order_delivered_carrier_date"),
    ("avg_carrier_shipping_time", "order_delivered_carrier_date", "order_delivered_customer_date"),
)


def _in_region(df: DataFrame, region: str | None) -> DataFrame:
    return df if region is None else df.filter(F.col(STATE) == region)


def _mean_days(total: str, n: str) -> F.Column:
    return ratio(F.col(total), F.col(n)) / F.lit(SECONDS_PER_DAY)


def revenue_by_state(shop: Shop, period: Period, region: str | None = None) -> DataFrame:
    """Revenue, orders and mean order value per state."""
    orders = period.keep(delivered(orders_of(shop, totals=True))).withColumn("orders", F.lit(1))
    states = _in_region(roll_up(shop, orders, STATE, sums=("revenue_cents", "orders")), region)
    return states.select(
        STATE,
        amount("revenue_cents").alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        ratio(amount("revenue_cents"), F.col("orders")).alias("avg_order_value"),
    )


def shipping_performance(shop: Shop, period: Period, region: str | None = None) -> DataFrame:
    """Actual against promised delivery days per state."""
    orders = (
        period.keep(delivered(orders_of(shop)))
        .filter(F.col("order_delivered_customer_date").isNotNull())
        .filter(F.col("order_estimated_delivery_date").isNotNull())
        .withColumn("actual", seconds_between(PURCHASE, "order_delivered_customer_date"))
        .withColumn("promised", seconds_between(PURCHASE, "order_estimated_delivery_date"))
        .withColumn("orders", F.lit(1))
    )
    states = _in_region(roll_up(shop, orders, STATE, sums=("actual", "promised", "orders")), region)
    return states.select(
        STATE,
        _mean_days("actual", "orders").alias("avg_actual_delivery_time_days"),
        _mean_days("promised", "orders").alias("avg_estimated_delivery_time_days"),
        F.col("orders").alias("num_orders_to_state"),
    ).withColumn(
        "delivery_variance_days",
        F.col("avg_actual_delivery_time_days") - F.col("avg_estimated_delivery_time_days"),
    )


def shipping_punctuality(shop: Shop, period: Period, region: str | None = None) -> DataFrame:
    """Shipping performance with a late / early label."""
    late = F.when(F.col("delivery_variance_days") > 0, "Late").otherwise("Early/OnTime")
    return shipping_performance(shop, period, region).withColumn("variance_color", late)


def delivery_breakdown(
    shop: Shop, period: Period, top_n: int = 5, region: str | None = None
) -> DataFrame:
    """Mean days per delivery stage in the states with the most delivered orders.

    One pass gives the order counts that pick the states and the stage sums, which
    only take orders that went through all stages.
    """
    complete = (
        F.col("order_approved_at").isNotNull()
        & F.col("order_delivered_carrier_date").isNotNull()
        & F.col("order_delivered_customer_date").isNotNull()
    )
    orders = period.keep(delivered(orders_of(shop))).select(
        "*",
        F.lit(1).alias("orders"),
        F.when(complete, 1).otherwise(0).alias("complete"),
        *(F.when(complete, seconds_between(a, b)).alias(name) for name, a, b in STAGES),
    )
    names = [name for name, _, _ in STAGES]
    states = _in_region(roll_up(shop, orders, STATE, sums=("orders", "complete", *names)), region)
    # A region names one state; only the report of all states is a top-n.
    chosen = states if region else states.orderBy(F.desc("orders"), F.asc_nulls_last(STATE)).limit(top_n)
    return (
        chosen.filter((F.col("complete") > 0) & F.col(STATE).isNotNull())
        .select(STATE, *(_mean_days(name, "complete").alias(name) for name in names))
    )


def delivery_stages(shop: Shop, period: Period, top_n: int = 5, region: str | None = None) -> DataFrame:
    """The breakdown as one row per state and stage."""
    return delivery_breakdown(shop, period, top_n, region).unpivot(
        STATE, [name for name, _, _ in STAGES], "time_segment", "avg_days"
    )


def delivery_times_by_state(shop: Shop, period: Period) -> DataFrame:
    """Mean delivery time per state, slowest first."""
    orders = (
        period.keep(delivered(orders_of(shop)))
        .withColumn("actual", seconds_between(PURCHASE, "order_delivered_customer_date"))
        .withColumn("timed", F.col("actual").isNotNull().cast("int"))
    )
    return (
        roll_up(shop, orders, STATE, sums=("actual", "timed"))
        .select(STATE, _mean_days("actual", "timed").alias("avg_delivery_days"))
        .orderBy(F.desc_nulls_first("avg_delivery_days"), STATE)
    )


def delivery_against_estimate(shop: Shop) -> DataFrame:
    """Mean whole days until delivery, actual and promised."""
    return delivered(orders_of(shop)).agg(
        exact_mean(whole_days(PURCHASE, "order_delivered_customer_date")).alias(
            "avg_actual_delivery_time"
        ),
        exact_mean(whole_days(PURCHASE, "order_estimated_delivery_date")).alias(
            "avg_estimated_delivery_time"
        ),
    )
