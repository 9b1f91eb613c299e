"""Order and item facts, and the skew-safe roll-ups the operators share.

Money is carried as whole cents until a result leaves an operator.

Measures are added up to the key of a join *before* the join. The map side then has
already folded a hot order, product or customer into one row per task, and the join
sees one row per key on both sides. What still joins at item grain (items with their
orders) leaves its hot keys to AQE's skew-join split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import cents
from mercadia.functions.params import MONTH, PURCHASE
from mercadia.sources.shop import Shop

PERSON, STATE = "customer_unique_id", "customer_state"
CATEGORY, CATEGORY_EN = "product_category_name", "product_category_name_english"


def revenue_cents() -> Column:
    return cents(F.col("price"), F.col("freight_value"))


def order_totals(shop: Shop) -> DataFrame:
    """One row per order with its item sums; a query pays only for the sums it reads."""
    line = F.col("order_item_id")
    price, freight = cents(F.col("price")), cents(F.col("freight_value"))
    return shop.order_items.groupBy("order_id").agg(
        F.sum(revenue_cents()).alias("revenue_cents"),
        F.count(F.when(F.col("price").isNotNull(), F.col("freight_value"))).alias("revenue_count"),
        F.sum(price).alias("price_cents"),
        F.count("price").alias("price_count"),
        F.sum(freight).alias("freight_cents"),
        F.count("freight_value").alias("freight_count"),
        F.count(F.lit(1)).alias("item_rows"),
        F.count("order_item_id").alias("item_count"),
        # The line number is a weight here, on purpose.
        (F.sum(price * line) + F.sum(freight * line)).alias("weighted_cents"),
    )


def orders_of(shop: Shop, *, totals: bool = False) -> DataFrame:
    """Order grain; ``totals`` adds the item sums and drops orders without items."""
    if shop.order_fact is not None:
        return shop.order_fact.filter(F.col("item_rows").isNotNull()) if totals else shop.order_fact
    return shop.orders.join(order_totals(shop), "order_id") if totals else shop.orders


def sales_of(shop: Shop) -> DataFrame:
    """Item grain with the status, time and customer of the order."""
    if shop.sales_fact is not None:
        return shop.sales_fact
    return shop.order_items.join(
        shop.orders.select("order_id", "customer_id", "order_status", PURCHASE), "order_id"
    )


def delivered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("order_status") == "delivered")


def of_known_customers(shop: Shop, df: DataFrame) -> DataFrame:
    """Rows whose customer has a row of its own."""
    if "has_customer" in df.columns:
        return df.filter("has_customer")
    return df.join(shop.customers.select("customer_id"), "customer_id", "left_semi")


def with_category(shop: Shop, df: DataFrame) -> DataFrame:
    """Attach both category names. Rows of unknown products drop out."""
    if CATEGORY_EN in df.columns:
        return df.filter(F.col("has_product"))
    return df.join(shop.products.select("product_id", CATEGORY, CATEGORY_EN), "product_id")


def roll_up(
    shop: Shop,
    df: DataFrame,
    attribute: str,
    *,
    sums: Iterable[str] = (),
    mins: Iterable[str] = (),
    maxs: Iterable[str] = (),
    keys: Iterable[str] = (),
) -> DataFrame:
    """Add up order-grain measures per customer attribute (person or state).

    Goes over ``customer_id`` first, so the join with customers meets one row per id,
    then over the attribute. Both steps combine on the map side.
    """
    keys = list(keys)
    measures = [
        *(F.sum(c).alias(c) for c in sums),
        *(F.min(c).alias(c) for c in mins),
        *(F.max(c).alias(c) for c in maxs),
    ]
    if attribute in df.columns:
        known = df.filter(F.col("has_customer"))
    else:
        per_id = df.groupBy("customer_id", *keys).agg(*measures)
        known = per_id.join(shop.customers.select("customer_id", attribute), "customer_id")
    return known.groupBy(attribute, *keys).agg(*measures)


def build_order_fact(shop: Shop) -> DataFrame:
    """Every order with its customer and item sums; nothing is dropped."""
    customer = shop.customers.select(
        "customer_id", PERSON, STATE, "customer_city", F.lit(True).alias("has_customer")
    )
    return (
        shop.orders.join(customer, "customer_id", "left")
        .join(order_totals(shop), "order_id", "left")
        .na.fill(False, ["has_customer"])
        .withColumn(MONTH, F.trunc(F.col(PURCHASE).cast("date"), "month"))
    )


def build_sales_fact(shop: Shop) -> DataFrame:
    """Every item of a known order with its customer and product names."""
    customer = shop.customers.select("customer_id", PERSON, STATE, F.lit(True).alias("has_customer"))
    product = shop.products.select("product_id", CATEGORY, CATEGORY_EN, F.lit(True).alias("has_product"))
    orders = shop.orders.select("order_id", "customer_id", "order_status", PURCHASE).join(
        customer, "customer_id", "left"
    )
    return (
        shop.order_items.join(orders, "order_id")
        .join(product, "product_id", "left")
        .na.fill(False, ["has_customer", "has_product"])
        .withColumn(MONTH, F.trunc(F.col(PURCHASE).cast("date"), "month"))
    )
