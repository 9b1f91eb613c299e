"""Customer behaviour: spend, repeat purchases, gaps, churn, favourite categories."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import (
    SECONDS_PER_DAY,
    amount,
    count_where,
    percent,
    ratio,
    seconds_between,
    with_row,
)
from mercadia.functions.params import PURCHASE, Period, ntz
from mercadia.plans.facts import (
    CATEGORY_EN,
    PERSON,
    delivered,
    orders_of,
    revenue_cents,
    roll_up,
    with_category,
)
from mercadia.sources.shop import Shop


def reference_time(shop: Shop, as_of: datetime | date | None) -> Column:
    """The moment "now" stands for: the given one, or the newest purchase."""
    return ntz(as_of) if as_of is not None else orders_of(shop).agg(F.max(PURCHASE)).scalar()


def _six_months_before(moment: Column) -> Column:
    return moment - F.make_ym_interval(F.lit(0), F.lit(6))


def spend_per_person(shop: Shop, period: Period) -> DataFrame:
    """Delivered revenue of each person in the period."""
    orders = period.keep(delivered(orders_of(shop, totals=True)))
    return roll_up(shop, orders, PERSON, sums=("revenue_cents",)).select(
        PERSON, amount("revenue_cents").alias("total_spent")
    )


def mean_spend(shop: Shop, period: Period) -> DataFrame:
    """Mean spend per person."""
    orders = period.keep(delivered(orders_of(shop, totals=True)))
    people = roll_up(shop, orders, PERSON, sums=("revenue_cents",))
    return people.agg(
        F.coalesce(ratio(amount(F.sum("revenue_cents")), F.count("revenue_cents")), F.lit(0.0)).alias(
            "avg_clv"
        )
    )


def spend_histogram(shop: Shop, period: Period, bins: int = 50) -> DataFrame:
    """Equal-width histogram of spend per person; bins count from 1, the last is closed."""
    spend = spend_per_person(shop, period).filter(F.col("total_spent").isNotNull())
    ends = spend.agg(F.min("total_spent").alias("low"), F.max("total_spent").alias("high"))
    low, high = F.col("ends.low"), F.col("ends.high")
    place = F.try_divide(F.col("total_spent") - low, high - low) * F.lit(float(bins))
    bin_no = F.least(F.floor(F.coalesce(place, F.lit(0.0))) + 1, F.lit(bins))
    return (
        with_row(spend, ends, "ends")
        .select(bin_no.cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("bin")
    )


def _order_counts(shop: Shop, orders: DataFrame) -> DataFrame:
    return roll_up(shop, orders.withColumn("orders", F.lit(1)), PERSON, sums=("orders",))


def repeat_customer_counts(shop: Shop, period: Period) -> DataFrame:
    """Persons with a delivered order in the period, and those with more than one."""
    people = _order_counts(shop, period.keep(delivered(orders_of(shop))))
    return people.agg(
        F.count(PERSON).alias("total_customers_in_period"),
        F.count(F.when(F.col("orders") > 1, F.col(PERSON))).alias("repeat_customers_in_period"),
    )


def repeat_rate(shop: Shop, period: Period) -> DataFrame:
    """Repeat customers in percent, 0 when there are no customers."""
    share = ratio(F.col("repeat_customers_in_period"), F.col("total_customers_in_period")) * 100.0
    return repeat_customer_counts(shop, period).select(
        F.coalesce(share, F.lit(0.0)).alias("repeat_rate_pct")
    )


def repeat_purchase_rate(shop: Shop) -> DataFrame:
    """Persons with more than one delivered order in percent of those with any."""
    people = _order_counts(shop, delivered(orders_of(shop)))
    return people.agg(
        percent(F.count(F.when(F.col("orders") > 1, F.col(PERSON))), F.count(PERSON)).alias(
            "repeat_purchase_rate"
        )
    )


def mean_days_between_orders(shop: Shop, period: Period) -> DataFrame:
    """Mean gap in days between consecutive delivered orders of the same person.

    The gaps of a person add up to last minus first order, so no ordering is needed.
    """
    orders = period.keep(delivered(orders_of(shop))).select(
        "*",
        F.col(PURCHASE).alias("first"),
        F.col(PURCHASE).alias("last"),
        F.lit(1).alias("orders"),
    )
    people = roll_up(shop, orders, PERSON, sums=("orders",), mins=("first",), maxs=("last",))
    gaps = F.sum(F.col("orders") - 1)
    return people.agg(
        (ratio(F.sum(seconds_between("first", "last")), gaps) / F.lit(SECONDS_PER_DAY)).alias(
            "avg_days_between_orders"
        )
    )


def top_categories_of(
    shop: Shop, period: Period, customer_type: str = "repeat", limit: int = 10
) -> DataFrame:
    """Best categories of repeat customers, or of customers whose first order is in the period.

    "Repeat" looks at all delivered orders up to the end of the period. For
    "first_time" an earlier order by an unknown person (NULL) empties the result,
    as a NOT IN over a list with a NULL does.
    """
    if customer_type == "repeat":
        history = period.keep_until_end(delivered(orders_of(shop)))
        chosen = _order_counts(shop, history).filter(F.col("orders") > 1)
    elif customer_type == "first_time":
        history = delivered(orders_of(shop)).withColumn("first", F.col(PURCHASE))
        firsts = roll_up(shop, history, PERSON, mins=("first",))
        unknown = firsts.filter(F.col(PERSON).isNull() & (F.col("first") < ntz(period.start)))
        chosen = period.keep(firsts, "first").filter(unknown.agg(F.count(F.lit(1))).scalar() == 0)
    else:
        raise ValueError(f"customer_type must be 'repeat' or 'first_time', not {customer_type!r}")

    chosen = chosen.select(PERSON)
    orders = period.keep(delivered(orders_of(shop)))
    if PERSON in orders.columns:
        picked = orders.filter(F.col("has_customer")).join(chosen, PERSON, "left_semi")
    else:
        ids = shop.customers.select("customer_id", PERSON).join(chosen, PERSON, "left_semi")
        picked = orders.join(ids, "customer_id", "left_semi")
    items = shop.order_items.select("order_id", "product_id", revenue_cents().alias("revenue_cents"))
    sold = with_category(shop, items.join(picked.select("order_id"), "order_id"))
    return (
        sold.filter(F.col(CATEGORY_EN).isNotNull())
        .groupBy(CATEGORY_EN, "order_id")
        .agg(F.sum("revenue_cents").alias("revenue_cents"))
        .groupBy(CATEGORY_EN)
        .agg(
            F.count("order_id").alias("total_orders_for_category"),
            amount(F.sum("revenue_cents")).alias("total_revenue_for_category"),
        )
        .orderBy(F.desc("total_revenue_for_category"), CATEGORY_EN)
        .limit(limit)
    )


def customer_rfm(shop: Shop) -> DataFrame:
    """Last purchase, number of delivered items and their price per person."""
    orders = delivered(orders_of(shop, totals=True)).withColumn("last", F.col(PURCHASE))
    return roll_up(shop, orders, PERSON, sums=("item_rows", "price_cents"), maxs=("last",)).select(
        PERSON,
        F.col("last").alias("last_purchase_date"),
        F.col("item_rows").alias("purchase_frequency"),
        amount("price_cents").alias("total_monetary_value"),
    )


def lifetime_value(shop: Shop) -> DataFrame:
    """Delivered item rows, their price, and price per row for each person."""
    people = roll_up(
        shop, delivered(orders_of(shop, totals=True)), PERSON, sums=("item_rows", "price_cents")
    )
    return people.select(
        PERSON,
        F.col("item_rows").alias("total_orders"),
        amount("price_cents").alias("total_revenue"),
        ratio(amount("price_cents"), F.col("item_rows")).alias("avg_order_value"),
    )


def churn_any_old_order(shop: Shop, as_of: datetime | None = None) -> DataFrame:
    """Persons with any order older than six months, in percent of all who ordered."""
    cutoff = _six_months_before(reference_time(shop, as_of))
    orders = orders_of(shop).withColumn("first", F.col(PURCHASE))
    people = roll_up(shop, orders, PERSON, mins=("first",)).filter(F.col(PERSON).isNotNull())
    return people.agg(
        percent(count_where(F.col("first") < cutoff), F.count(PERSON)).alias("churn_rate")
    )


def churn_last_delivered(shop: Shop, as_of: date | None = None) -> DataFrame:
    """Persons whose last delivered order is older than six months, in percent of all persons."""
    today = reference_time(shop, as_of).cast("date").cast("timestamp_ntz")
    orders = delivered(orders_of(shop)).withColumn("last", F.col(PURCHASE))
    last = roll_up(shop, orders, PERSON, maxs=("last",)).filter(F.col(PERSON).isNotNull())
    everyone = shop.customers.groupBy(PERSON).agg(F.count(F.lit(1)).alias("ids")).agg(F.count(PERSON))
    return last.agg(
        percent(count_where(F.col("last") < _six_months_before(today)), everyone.scalar()).alias(
            "churn_rate"
        )
    )
