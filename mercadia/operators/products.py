"""Product portfolio: category matrix, return rates, rankings, best sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, as_double, cents, percent, ratio
from mercadia.functions.params import Period
from mercadia.plans.facts import (
    CATEGORY,
    CATEGORY_EN,
    delivered,
    revenue_cents,
    sales_of,
    with_category,
)
from mercadia.sources.shop import Shop

MEASURES = ("total_revenue", "total_units_sold", "return_rate_percentage")


def _reviews_per_order(shop: Shop) -> DataFrame:
    return shop.reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("review_score").alias("n_scores"),
        F.sum("review_score").alias("score_sum"),
    )


def _reviewed_sales(shop: Shop, period: Period) -> DataFrame:
    """Items of the period with the folded reviews of their order.

    The reviews go to the order side, so items meet orders in one join, whose hot orders Spark
    splits; only sums per product and line are shuffled after it.
    """
    if shop.sales_fact is not None:
        return period.keep(shop.sales_fact).join(_reviews_per_order(shop), "order_id", "left")
    orders = period.keep(shop.orders).select("order_id", "customer_id", "order_status")
    return shop.order_items.join(orders.join(_reviews_per_order(shop), "order_id", "left"), "order_id")


def _category_lines(shop: Shop, items: DataFrame) -> DataFrame:
    """Sums per category and line number; an item counts once per review of its order."""
    is_delivered, is_canceled = F.col("order_status") == "delivered", F.col("order_status") == "canceled"
    copies = F.coalesce(F.col("n_reviews"), F.lit(1))
    measures = {
        "revenue_cents": F.when(is_delivered, revenue_cents() * copies),
        "n_scores": F.when(is_delivered, F.col("n_scores")),
        "score_sum": F.when(is_delivered, F.col("score_sum")),
        "delivered": F.when(is_delivered, 1).otherwise(0),
        "canceled": F.when(is_canceled, 1).otherwise(0),
        "all": F.lit(1),
    }
    per_product = items.groupBy("product_id", "order_item_id").agg(*(F.sum(m).alias(n) for n, m in measures.items()))
    return (
        with_category(shop, per_product)
        .filter(F.col(CATEGORY_EN).isNotNull())
        .groupBy(CATEGORY_EN, "order_item_id")
        .agg(*(F.sum(n).alias(n) for n in measures))
    )


def _performance() -> list[Column]:
    """Revenue, units and mean score of a category, out of its lines."""
    units = F.count(F.when(F.col("delivered") > 0, F.col("order_item_id")))
    return [
        amount(F.sum("revenue_cents")).alias("total_revenue"),
        units.alias("total_units_sold"),
        F.coalesce(ratio(F.sum("score_sum"), F.sum("n_scores")), F.lit(0.0)).alias("avg_review_score"),
    ]


def category_performance(shop: Shop, period: Period) -> DataFrame:
    """Revenue, units and mean score per category of delivered items.

    An item counts once per review of its order, as a plain left join would have it.
    The reviews are counted per order and multiplied in, so nothing fans out.
    """
    lines = _category_lines(shop, delivered(_reviewed_sales(shop, period)))
    return lines.groupBy(CATEGORY_EN).agg(*_performance()).filter(F.col("total_units_sold") > 0)


def category_return_rates(shop: Shop, period: Period) -> DataFrame:
    """Items of canceled orders in percent of all items, per category."""
    canceled = F.col("order_status") == "canceled"
    per_product = (
        period.keep(sales_of(shop))
        .groupBy("product_id")
        .agg(F.count(F.when(canceled, F.col("order_id"))).alias("canceled"), F.count("order_id").alias("all"))
    )
    return (
        with_category(shop, per_product)
        .filter(F.col(CATEGORY_EN).isNotNull())
        .groupBy(CATEGORY_EN)
        .agg(percent(F.sum("canceled"), F.sum("all")).alias("return_rate_percentage"))
    )


def category_matrix(shop: Shop, period: Period) -> DataFrame:
    """Category performance with return rates, in one pass over the items; gaps become 0."""
    rate = percent(F.sum("canceled"), F.sum("all"))
    return (
        _category_lines(shop, _reviewed_sales(shop, period))
        .groupBy(CATEGORY_EN)
        .agg(*_performance(), rate.alias("return_rate_percentage"))
        .filter(F.col("total_units_sold") > 0)
        .na.fill(0.0, ["total_revenue", "avg_review_score", "return_rate_percentage"])
    )


def top_categories(shop: Shop, period: Period) -> DataFrame:
    """The leading category by revenue, by units and by return rate; ties go to the first by name."""
    long = (
        category_matrix(shop, period)
        .withColumn("total_units_sold", as_double("total_units_sold"))
        .unpivot(CATEGORY_EN, list(MEASURES), "measure", "value")
    )
    best = F.min(F.struct((-F.col("value")).alias("rank"), CATEGORY_EN, "value"))
    return long.groupBy("measure").agg(best.alias("best")).select(f"best.{CATEGORY_EN}", "measure", "best.value")


def category_ranking(shop: Shop, period: Period, measure: str = "total_revenue", n: int = 10) -> DataFrame:
    """Best and worst ``n`` categories by revenue or units."""
    if measure not in MEASURES[:2]:
        raise ValueError(f"measure must be one of {MEASURES[:2]}, not {measure!r}")
    matrix = category_matrix(shop, period).select(CATEGORY_EN, as_double(measure).alias("value"))
    top = matrix.orderBy(F.desc("value"), CATEGORY_EN).limit(n)
    bottom = matrix.orderBy("value", F.desc(CATEGORY_EN)).limit(n)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


def top_return_rates(shop: Shop, period: Period, n: int = 15) -> DataFrame:
    return (
        category_return_rates(shop, period).orderBy(F.desc("return_rate_percentage"), CATEGORY_EN).limit(n)
    )


def top_selling_products(shop: Shop, period: Period, n: int = 10) -> DataFrame:
    """Products with the most delivered items in the period."""
    per_product = (
        period.keep(delivered(sales_of(shop)))
        .groupBy("product_id")
        .agg(F.count("order_id").alias("total_sales"), F.sum(cents(F.col("price"))).alias("price_cents"))
    )
    return (
        with_category(shop, per_product)
        .orderBy(F.desc("total_sales"), "product_id")
        .limit(n)
        .select("product_id", CATEGORY, "total_sales", amount("price_cents").alias("total_revenue"))
    )


def top_selling_categories(shop: Shop, n: int = 10) -> DataFrame:
    """Categories with the most items, any status; items without a category are one group."""
    per_product = shop.order_items.groupBy("product_id").agg(F.count("product_id").alias("sold"))
    return (
        with_category(shop, per_product)
        .groupBy(F.col(CATEGORY_EN).alias("category"))
        .agg(F.sum("sold").alias("total_sales"))
        .orderBy(F.desc("total_sales"), F.asc_nulls_last("category"))
        .limit(n)
    )
