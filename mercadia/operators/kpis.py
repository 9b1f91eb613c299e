"""Business health: headline figures, trends, new against returning customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, cents, period_start, ratio
from mercadia.functions.params import PURCHASE, Period, granularity_of, ntz
from mercadia.plans.facts import PERSON, delivered, of_known_customers, orders_of, roll_up
from mercadia.sources.shop import Shop

# Fixed value: assumed share of revenue that is cost of goods.
COST_SHARE = 0.6

KPIS = ("total_orders", "total_revenue", "avg_order_value", "active_customers", "new_customers")


def _delivered_totals(shop: Shop, period: Period) -> DataFrame:
    return period.keep(delivered(orders_of(shop, totals=True)))


def _figures(shop: Shop, orders: DataFrame, *keys: str) -> DataFrame:
    """Headline figures of delivered orders, one row or one per value of the keys."""
    people = roll_up(shop, orders.withColumn("orders", F.lit(1)), PERSON, keys=keys, sums=("revenue_cents", "orders"))
    return people.groupBy(*keys).agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        amount(F.sum("revenue_cents")).alias("total_revenue"),
        ratio(amount(F.sum("revenue_cents")), F.sum("orders")).alias("avg_order_value"),
        F.count(PERSON).alias("active_customers"),
        F.count(PERSON).alias("new_customers"),
    )


def main_kpis(shop: Shop, period: Period) -> DataFrame:
    """Headline figures of a period, one row; an empty period gives 0 and NULL.

    A customer counts as new when first seen inside the period, so every active
    customer is new. That is the defined meaning of the figure.
    """
    return _figures(shop, _delivered_totals(shop, period))


def kpis_first_ever(shop: Shop, period: Period) -> DataFrame:
    """Headline figures in which a customer is new when the first delivered order ever falls in the period.

    One pass over all delivered orders up to the end of the period.
    """
    history = period.keep_until_end(delivered(orders_of(shop, totals=True)))
    inside = F.col(PURCHASE) >= ntz(period.start)
    orders = history.withColumns(
        {
            "own_cents": F.when(inside, F.col("revenue_cents")),
            "orders": F.when(inside, 1).otherwise(0),
            "first": F.col(PURCHASE),
        }
    )
    people = roll_up(shop, orders, PERSON, sums=("own_cents", "orders"), mins=("first",))
    revenue = amount(F.sum("own_cents"))
    return people.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        revenue.alias("total_revenue"),
        ratio(revenue, F.sum("orders")).alias("avg_order_value"),
        F.count(F.when(F.col("orders") > 0, F.lit(1))).alias("active_customers"),
        F.count(F.when(F.col("first") >= ntz(period.start), F.lit(1))).alias("new_customers"),
    )


def kpis_against_previous(shop: Shop, period: Period) -> DataFrame:
    """Headline figures of the period, of the one before, and their difference.

    Both periods are read in one pass; every order carries the period that it falls in.
    """
    earlier = period.previous()
    when = F.col(PURCHASE)
    current = F.when(when >= ntz(period.start), True).when(when <= ntz(earlier.end), False)
    orders = _delivered_totals(shop, Period(earlier.start, period.end)).withColumn("current", current)
    figures = _figures(shop, orders.filter(F.col("current").isNotNull()), "current")
    counts = ("total_orders", "active_customers", "new_customers")

    def pick(name: str, current: bool) -> Column:
        value = F.max(F.when(F.col("current") == current, F.col(name)))
        return F.coalesce(value, F.lit(0)) if name in counts else value

    return figures.agg(
        *(pick(k, True).alias(k) for k in KPIS),
        *(pick(k, False).alias(f"previous_{k}") for k in KPIS),
        *((pick(k, True) - pick(k, False)).alias(f"delta_{k}") for k in KPIS),
    )


def gross_margin(shop: Shop, period: Period) -> DataFrame:
    """Margin under the assumed cost share."""
    cost = F.col("total_revenue") * F.lit(COST_SHARE)
    return (
        main_kpis(shop, period)
        .select("total_revenue", cost.alias("cogs"))
        .withColumn("gross_profit", F.col("total_revenue") - F.col("cogs"))
        .withColumn(
            "gross_margin_pct",
            F.coalesce(ratio(F.col("gross_profit"), F.col("total_revenue")) * 100.0, F.lit(0.0)),
        )
    )


def new_customer_rate(shop: Shop, period: Period) -> DataFrame:
    """Share of new among active customers in percent, 0 when nobody was active."""
    rate = ratio(F.col("new_customers"), F.col("active_customers")) * 100.0
    return main_kpis(shop, period).select(
        "new_customers",
        "active_customers",
        F.coalesce(rate, F.lit(0.0)).alias("new_customer_rate_pct"),
    )


def revenue_orders_trend(shop: Shop, period: Period, freq: str = "ME") -> DataFrame:
    """Revenue and number of delivered orders over time."""
    return (
        _delivered_totals(shop, period)
        .groupBy(period_start(granularity_of(freq), PURCHASE).alias("time_period"))
        .agg(
            amount(F.sum("revenue_cents")).alias("total_revenue"), F.count("order_id").alias("total_orders")
        )
        .orderBy("time_period")
    )


def aov_trend(shop: Shop, period: Period, freq: str = "ME") -> DataFrame:
    """Mean order value over time."""
    return (
        _delivered_totals(shop, period)
        .groupBy(period_start(granularity_of(freq), PURCHASE).alias("time_period"))
        .agg(ratio(amount(F.sum("revenue_cents")), F.count("order_id")).alias("avg_order_value"))
        .orderBy("time_period")
    )


def new_vs_returning_revenue(shop: Shop, period: Period, freq: str = "ME") -> DataFrame:
    """Revenue of first orders against later ones, ranked over all history so far.

    The first order of a person is the smallest (time, order id), found by a plain
    aggregate; it is then matched by order id, so no person is ever held in one task.
    """
    history = period.keep_until_end(delivered(orders_of(shop))).withColumn(
        "first", F.struct(PURCHASE, "order_id")
    )
    first = (
        roll_up(shop, history, PERSON, mins=("first",))
        .filter(F.col(f"first.{PURCHASE}").isNotNull())
        .select(F.col("first.order_id").alias("order_id"), F.lit(True).alias("is_first"))
    )
    is_new = F.coalesce(F.col("is_first"), F.lit(False))
    return (
        of_known_customers(shop, _delivered_totals(shop, period))
        .join(first, "order_id", "left")
        .groupBy(period_start(granularity_of(freq), PURCHASE).alias("time_period"))
        .agg(
            amount(F.sum(F.when(is_new, F.col("revenue_cents")).otherwise(0))).alias("new_customer_revenue"),
            amount(F.sum(F.when(~is_new, F.col("revenue_cents")).otherwise(0))).alias(
                "returning_customer_revenue"
            ),
        )
        .orderBy("time_period")
    )


def monthly_price_revenue(shop: Shop, period: Period | None = None) -> DataFrame:
    """Delivered revenue per month without freight; all history when no period is given."""
    orders = delivered(orders_of(shop, totals=True))
    if period is not None:
        orders = period.keep(orders)
    return (
        orders.groupBy(period_start("month", PURCHASE).alias("month"))
        .agg(amount(F.sum("price_cents")).alias("total_revenue"))
        .orderBy("month")
    )


def average_order_value(shop: Shop) -> DataFrame:
    """Item price per order over all items, any status."""
    per_order = shop.order_items.groupBy("order_id").agg(F.sum(cents(F.col("price"))).alias("price_cents"))
    return per_order.agg(
        ratio(amount(F.sum("price_cents")), F.count("order_id")).alias("avg_order_value")
    )


def average_shipping_cost(shop: Shop) -> DataFrame:
    """Mean freight per item."""
    return shop.order_items.agg(
        ratio(F.sum("freight_value"), F.count("freight_value")).alias("avg_shipping_cost")
    )
