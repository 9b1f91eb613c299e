"""Per-customer, per-product and per-order features, and the table updates made of them.

Spark tables are rewritten, not updated in place: a matched row takes the new value, an
unmatched one keeps what it had.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, as_double, percent, ratio, whole_days
from mercadia.functions.params import PURCHASE, ntz
from mercadia.functions.ranks import numbered, ranged
from mercadia.operators.customers import reference_time
from mercadia.plans.checkpoints import cut_lineage
from mercadia.plans.facts import (
    CATEGORY,
    PERSON,
    delivered,
    order_totals,
    orders_of,
    roll_up,
    sales_of,
    with_category,
)
from mercadia.sources.shop import Shop

# --- one value per person -------------------------------------------------------------


def days_since_last_purchase(shop: Shop, as_of: datetime | None = None) -> DataFrame:
    """Whole days from the last order (any status) to the reference time."""
    last = roll_up(shop, orders_of(shop).withColumn("last", F.col(PURCHASE)), PERSON, maxs=("last",))
    days = whole_days(F.col("last"), reference_time(shop, as_of))
    return last.select(PERSON, F.coalesce(days, F.lit(0)).alias("days_since_last_purchase"))


def _days_of_orders(shop: Shop, orders: DataFrame) -> DataFrame:
    """First order, last order and number of orders per person and calendar day."""
    daily = orders.select(
        "*",
        F.col(PURCHASE).cast("date").alias("day"),
        F.col(PURCHASE).alias("first"),
        F.col(PURCHASE).alias("last"),
        F.col(PURCHASE).isNotNull().cast("int").alias("orders"),
    )
    return roll_up(shop, daily, PERSON, keys=("day",), sums=("orders",), mins=("first",), maxs=("last",))


def _gap_to_next_day() -> Column:
    """Whole days from the last order of a day to the first of the person's next day.

    Days without such orders have no first order; they sort last and give NULL.
    """
    in_time = Window.partitionBy(PERSON).orderBy(F.asc_nulls_last("first"))
    return whole_days(F.col("last"), F.lead("first").over(in_time))


def order_gaps(shop: Shop, *, delivered_only: bool, single_order_default: int) -> DataFrame:
    """Mean whole-day gap between consecutive orders of a person.

    Two orders of one day are less than a day apart and add 0, so the orders are first
    folded per person and day. The window then sees at most one row per calendar day of
    a person, however many orders that person placed.
    """
    orders = delivered(orders_of(shop)) if delivered_only else orders_of(shop)
    days = _days_of_orders(shop, orders).withColumn("gap_days", _gap_to_next_day())
    gaps = F.greatest(F.sum("orders") - 1, F.lit(0))
    mean = ratio(F.coalesce(F.sum("gap_days"), F.lit(0)), gaps)
    return days.groupBy(PERSON).agg(
        F.coalesce(mean, F.lit(float(single_order_default))).alias("avg_days_between_orders")
    )


def order_frequency(shop: Shop) -> DataFrame:
    """Number of orders per person, any status."""
    orders = orders_of(shop).withColumn("orders", F.lit(1))
    return roll_up(shop, orders, PERSON, sums=("orders",)).select(
        PERSON, F.col("orders").alias("total_orders")
    )


def person_order_value(shop: Shop) -> DataFrame:
    """Price sum, orders and mean item price per person, any status."""
    orders = orders_of(shop, totals=True).withColumn("orders", F.lit(1))
    people = roll_up(shop, orders, PERSON, sums=("price_cents", "price_count", "orders"))
    return people.select(
        PERSON,
        amount("price_cents").alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        ratio(amount("price_cents"), F.col("price_count")).alias("avg_order_value"),
    )


def person_mean_price(shop: Shop) -> DataFrame:
    """Mean item price per person."""
    return person_order_value(shop).select(PERSON, "avg_order_value")


def person_mean_freight(shop: Shop) -> DataFrame:
    """Mean freight per item and person."""
    people = roll_up(
        shop, orders_of(shop, totals=True), PERSON, sums=("freight_cents", "freight_count")
    )
    return people.select(
        PERSON, ratio(amount("freight_cents"), F.col("freight_count")).alias("avg_shipping_cost")
    )


def person_payment_types(shop: Shop) -> DataFrame:
    """Payments per person and type."""
    payments = shop.payments.select("order_id", "payment_type", F.lit(1).alias("total_payments"))
    paid = payments.join(orders_of(shop), "order_id")
    return roll_up(shop, paid, PERSON, keys=("payment_type",), sums=("total_payments",))


def preferred_payment_types(shop: Shop) -> DataFrame:
    """The type that a person paid with most often; ties go to the type that sorts first."""
    counts = person_payment_types(shop)
    order = F.struct((-F.col("total_payments")).alias("n"), F.col("payment_type").isNull().alias("unset"), "payment_type")
    best = counts.groupBy(PERSON).agg(F.min(order).alias("best"), F.sum("total_payments").alias("payments"))
    return best.select(PERSON, F.col("best.payment_type").alias("preferred_payment_type"), "payments")


def person_canceled_share(shop: Shop) -> DataFrame:
    """Canceled orders of a person in percent."""
    orders = orders_of(shop).select(
        "*",
        F.lit(1).alias("orders"),
        F.when(F.col("order_status") == "canceled", 1).otherwise(0).alias("canceled"),
    )
    return roll_up(shop, orders, PERSON, sums=("orders", "canceled")).select(
        PERSON, percent(F.col("canceled"), F.col("orders")).alias("estimated_return_rate")
    )


def order_values(shop: Shop) -> DataFrame:
    """Price and freight of an order, each weighted by the line number."""
    return order_totals(shop).select("order_id", amount("weighted_cents").alias("total_order_value"))


# --- purchase counts ------------------------------------------------------------------


def customer_product_counts(shop: Shop) -> DataFrame:
    """Delivered items per customer id and product: the one aggregate that all purchase counts follow from."""
    sold = delivered(sales_of(shop))
    return sold.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("total_purchases"))


def person_product_counts(shop: Shop, counts: DataFrame | None = None) -> DataFrame:
    """Delivered items per person and product."""
    if counts is None and shop.sales_fact is not None:
        sold = delivered(sales_of(shop)).withColumn("total_purchases", F.lit(1))
    else:
        sold = customer_product_counts(shop) if counts is None else counts
    return roll_up(shop, sold, PERSON, keys=("product_id",), sums=("total_purchases",))


def product_popularity(shop: Shop, counts: DataFrame | None = None) -> DataFrame:
    """Delivered items per product."""
    if counts is None:
        return delivered(sales_of(shop)).groupBy("product_id").agg(F.count(F.lit(1)).alias("total_sales"))
    return counts.groupBy("product_id").agg(F.sum("total_purchases").alias("total_sales"))


def ranked_product_popularity(shop: Shop, counts: DataFrame | None = None) -> DataFrame:
    """Product popularity with its rank from 1, most sold first; ties by product.

    The products are dealt to tasks by ranges of the ranking, numbered there, and the counts of the
    ranges before are added, so no task sees all products.
    """
    order = [F.desc("total_sales"), F.col("product_id")]
    dealt = cut_lineage(ranged(product_popularity(shop, counts), [], order))
    return numbered(dealt, [], order, "popularity_rank")


def person_category_counts(shop: Shop, counts: DataFrame | None = None) -> DataFrame:
    """Delivered items per person and category."""
    return (
        with_category(shop, person_product_counts(shop, counts))
        .groupBy(PERSON, F.col(CATEGORY).alias("category"))
        .agg(F.sum("total_purchases").alias("total_purchases"))
    )


def purchase_documents(shop: Shop, parts: int = 1) -> DataFrame:
    """Purchase counts of a person as JSON arrays, sorted by product.

    ``person_product_counts`` has the same counts as rows. Every person's products are
    dealt by hash to the same number of ``parts``, each a document of its own, so the grain
    does not depend on the data; choose more parts where persons have very many products. A row
    says which ``document`` it is and of how many ``documents``.
    """
    part = F.pmod(F.xxhash64("product_id"), F.lit(parts))
    return (
        person_product_counts(shop)
        .groupBy(PERSON, part.alias("document"))
        .agg(
            F.to_json(
                F.array_sort(F.collect_list(F.struct("product_id", "total_purchases")))
            ).alias("product_purchases")
        )
        .withColumn("documents", F.lit(parts))
    )


# --- table updates --------------------------------------------------------------------


def _set(table: DataFrame, new: DataFrame, key: str, matched: dict[str, Column]) -> DataFrame:
    """Left join ``new`` on ``key``; each column is replaced where its condition holds."""
    fresh = new.select(F.col(key).alias("_key"), *(c for c in new.columns if c != key))
    fresh = fresh.select("_key", *(F.col(c).alias(f"_new_{c}") for c in fresh.columns if c != "_key"))
    joined = table.join(fresh, F.col(key) == F.col("_key"), "left")

    def value(name: str, condition: Column) -> Column:
        old = F.col(name) if name in table.columns else F.lit(None)
        return F.when(condition, F.col(f"_new_{name}")).otherwise(old).alias(name)

    kept = [c for c in table.columns if c not in matched]
    return joined.select(*kept, *(value(name, condition) for name, condition in matched.items()))


def customer_features(shop: Shop) -> DataFrame:
    """All customer features in one pass over the orders, with the counts that tell
    which of them a person has."""
    is_delivered = F.col("order_status") == "delivered"
    if shop.order_fact is not None:
        orders = shop.order_fact
    else:
        orders = shop.orders.join(order_totals(shop), "order_id", "left")

    def of_delivered(name: str) -> Column:
        return F.when(is_delivered, F.col(name)).alias(f"d_{name}")

    sums = ("revenue_cents", "revenue_count", "freight_cents", "freight_count", "item_rows")
    wide = orders.select(
        "*",
        F.col(PURCHASE).cast("date").alias("day"),
        F.lit(1).alias("orders"),
        F.when(F.col("order_status") == "canceled", 1).otherwise(0).alias("canceled"),
        F.when(is_delivered, 1).otherwise(0).alias("delivered"),
        F.when(is_delivered & F.col(PURCHASE).isNotNull(), 1).otherwise(0).alias("timed"),
        F.when(is_delivered, F.col(PURCHASE)).alias("first"),
        F.when(is_delivered, F.col(PURCHASE)).alias("last"),
        *(of_delivered(s) for s in sums),
    )
    added = ("orders", "canceled", "delivered", "timed", *(f"d_{s}" for s in sums))
    days = roll_up(shop, wide, PERSON, keys=("day",), sums=added, mins=("first",), maxs=("last",))
    people = days.withColumn("gap_days", _gap_to_next_day()).groupBy(PERSON).agg(
        *(F.sum(c).alias(c) for c in added), F.sum("gap_days").alias("gap_days")
    )
    gaps = F.greatest(F.col("timed") - 1, F.lit(0))
    return people.select(
        PERSON,
        "delivered",
        F.col("d_item_rows").alias("delivered_items"),
        "orders",
        amount("d_revenue_cents").alias("clv"),
        F.coalesce(ratio(F.coalesce("gap_days", F.lit(0)), gaps), F.lit(0.0)).alias(
            "avg_days_between_orders"
        ),
        F.col("delivered").cast("int").alias("total_orders"),
        F.coalesce(ratio(amount("d_revenue_cents"), F.col("d_revenue_count")), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(ratio(amount("d_freight_cents"), F.col("d_freight_count")), F.lit(0.0)).alias(
            "avg_shipping_cost"
        ),
        percent(F.col("canceled"), F.col("orders")).alias("estimated_return_rate"),
    )


def update_customers(shop: Shop) -> DataFrame:
    """The customers table with its feature columns, repeated for every id of a person."""
    features = customer_features(shop)
    has_items = F.col("_new_delivered_items") > 0
    has_delivered = F.col("_new_delivered") > 0
    return _set(
        shop.customers,
        features,
        PERSON,
        {
            "clv": has_items,
            "avg_days_between_orders": has_delivered,
            "total_orders": has_delivered,
            "avg_order_value": has_items,
            "avg_shipping_cost": has_items,
            "estimated_return_rate": F.col("_new_orders") > 0,
        },
    )


def customer_purchase_documents(shop: Shop, parts: int = 1) -> DataFrame:
    """Each customer id with the purchase documents of its person.

    Documents repeat for every id, as the column they stand for does; the batch job
    stores them once per person.
    """
    documents = purchase_documents(shop, parts)
    return shop.customers.select("customer_id", PERSON).join(documents, PERSON, "left")


def update_products(shop: Shop) -> DataFrame:
    """The products table with its popularity score."""
    new = product_popularity(shop).select("product_id", as_double("total_sales").alias("popularity_score"))
    return _set(shop.products, new, "product_id", {"popularity_score": F.col("_key").isNotNull()})


def update_orders(shop: Shop) -> DataFrame:
    """The orders table with its weighted order value."""
    return _set(
        shop.orders, order_values(shop), "order_id", {"total_order_value": F.col("_key").isNotNull()}
    )


# --- feature store --------------------------------------------------------------------


def precomputed_features(shop: Shop, computed_at: datetime) -> DataFrame:
    """The three purchase rollups as rows of one feature table, a JSON object per entry.

    All three follow from one aggregate of the items, which is stored once.
    """

    def entries(name: str, df: DataFrame) -> DataFrame:
        return df.select(
            F.lit(name).alias("feature_name"),
            F.to_json(F.struct(*df.columns)).alias("feature_value"),
            ntz(computed_at).alias("computed_at"),
        )

    counts = cut_lineage(customer_product_counts(shop))
    # The names of the three features.
    return (
        entries("customer_product_purchases", person_product_counts(shop, counts))
        .unionByName(entries("top_product_popularity", ranked_product_popularity(shop, counts)))
        .unionByName(entries("customer_top_categories", person_category_counts(shop, counts)))
    )
