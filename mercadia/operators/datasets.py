"""Model inputs: sales series, outlier removal, segmentation and recommendation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, cents, nan_to_null, period_start
from mercadia.functions.params import PURCHASE
from mercadia.operators.features import person_product_counts, update_customers
from mercadia.plans.facts import CATEGORY_EN, PERSON, STATE, delivered, roll_up, sales_of
from mercadia.plans.facts import order_totals as totals_of
from mercadia.plans.quantiles import exact_quantiles
from mercadia.sources.shop import Shop

# Series name → granularity of its steps.
SERIES = {"quarterly": "quarter", "weekly": "week", "daily": "day"}


def sales_series(shop: Shop, frequency: str, by: str | None = None) -> DataFrame:
    """Delivered order value per step as (ds, y); ``by`` splits it per state or the like."""
    if shop.order_fact is not None:
        orders = shop.order_fact
    else:
        orders = shop.orders.join(totals_of(shop), "order_id", "left")
    steps = delivered(orders).withColumn("ds", period_start(SERIES[frequency], PURCHASE).cast("date"))
    if by is None:
        series = steps.groupBy("ds").agg(F.sum("weighted_cents").alias("weighted_cents"))
        return series.select("ds", amount("weighted_cents").alias("y"))
    series = roll_up(shop, steps, by, keys=("ds",), sums=("weighted_cents",))
    return series.select(F.col(by).alias("series_id"), "ds", amount("weighted_cents").alias("y"))


def sales_series_levels(shop: Shop, frequencies: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Delivered order value per step of the shop, each state, each category, and each pair of them.

    Rows (frequency, level, state, category, series_id, ds, y). One pass over the items: they are
    added up per customer id, product and day, then per state and product, then per state and
    category, so every join meets folded rows; grouping sets over the calendar make the levels.
    Items of unknown customers or products count in the state or category NULL, so each level
    has the same sum.
    """
    day = F.col(PURCHASE).cast("date").alias("day")
    line = F.col("order_item_id")
    value = (cents(F.col("price")) * line, cents(F.col("freight_value")) * line)

    def added(df: DataFrame, *keys: Column | str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("price_cents").alias("price_cents"), F.sum("freight_cents").alias("freight_cents"))

    items = delivered(sales_of(shop)).withColumns(dict(zip(("price_cents", "freight_cents"), value)))
    if STATE in items.columns:
        daily = added(items, STATE, CATEGORY_EN, day)
    else:
        per_id = added(items, "customer_id", "product_id", day)
        known = per_id.join(shop.customers.select("customer_id", STATE), "customer_id", "left")
        per_product = added(known, STATE, "product_id", "day")
        named = per_product.join(shop.products.select("product_id", CATEGORY_EN), "product_id", "left")
        daily = added(named, STATE, CATEGORY_EN, "day")
    starts = [
        F.struct(F.lit(name).alias("frequency"), period_start(SERIES[name], "day").cast("date").alias("ds"))
        for name in frequencies
    ]
    steps = daily.withColumn("step", F.explode(F.array(*starts))).select("step.*", STATE, CATEGORY_EN, "price_cents", "freight_cents")
    time = [F.col("frequency"), F.col("ds")]
    sets = [[*time, *(F.col(c) for c in level)] for level in ((), (STATE,), (CATEGORY_EN,), (STATE, CATEGORY_EN))]
    summed = steps.groupingSets(sets, *time, STATE, CATEGORY_EN).agg(
        F.sum("price_cents").alias("price_cents"),
        F.sum("freight_cents").alias("freight_cents"),
        F.grouping(STATE).alias("_all_states"),
        F.grouping(CATEGORY_EN).alias("_all_categories"),
    )
    by_state, by_category = F.col("_all_states") == 0, F.col("_all_categories") == 0
    level = (
        F.when(by_state & by_category, "state_category").when(by_state, "state").when(by_category, "category").otherwise("shop")
    )

    def part(name: str, column: str, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(f"/{name}="), F.coalesce(F.col(column), F.lit("?")))).otherwise("")

    series_id = F.concat("frequency", part("state", STATE, by_state), part("category", CATEGORY_EN, by_category))
    return summed.select(
        "frequency",
        level.alias("level"),
        F.col(STATE).alias("state"),
        F.col(CATEGORY_EN).alias("category"),
        series_id.alias("series_id"),
        "ds",
        amount(F.col("price_cents") + F.col("freight_cents")).alias("y"),
    )


def level_totals(series: DataFrame) -> DataFrame:
    """Sum of each level's series, to the cent; equal for all levels of a frequency."""
    return series.groupBy("frequency", "level").agg(
        F.round(F.sum("y"), 2).alias("total"), F.count_distinct("series_id").alias("series")
    )


def remove_outliers_log(
    df: DataFrame, column: str, factor: float = 1.5, by: Sequence[str] = (), unbounded: bool = False
) -> DataFrame:
    """Keep rows whose logarithm is within ``factor`` interquartile ranges of the quartiles.

    Values of 0 or below are an error; NaN and NULL rows drop out. The quartiles are exact. Those
    of an aggregated series, whose length the calendar bounds, are taken in one task per series;
    for raw rows set ``unbounded``, and no task gathers the values of a group.
    """
    value = nan_to_null(F.col(column))
    problem = F.raise_error(F.lit("the logarithm needs values above 0"))
    log_value = F.when(value <= 0, problem.cast("double")).otherwise(F.ln(value))
    logged = df.withColumn("_log", log_value)
    if unbounded:
        quartiles = exact_quantiles(logged, "_log", (0.25, 0.75), by).withColumnRenamed("quantiles", "_q")
    else:
        quartiles = logged.groupBy(*by).agg(F.percentile("_log", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    if by:
        logged = logged.join(quartiles, list(by))
    else:
        logged = logged.withColumn("_q", quartiles.scalar())
    low, high = F.col("_q")[0], F.col("_q")[1]
    reach = (high - low) * F.lit(float(factor))
    return logged.filter(F.col("_log").between(low - reach, high + reach)).select(df.columns)


def segmentation_dataset(shop: Shop, grain: str = "customer") -> DataFrame:
    """Feature columns of every customer id, or of every person; people with several ids repeat in the first.

    A person with several ids takes the first state and city by name.
    """
    if grain not in ("customer", "person"):
        raise ValueError(f"grain must be customer or person, not {grain!r}")
    # The nine columns of the data set.
    rows = update_customers(shop).select(
        PERSON,
        "customer_state",
        "customer_city",
        "clv",
        "total_orders",
        "avg_order_value",
        "avg_days_between_orders",
        "avg_shipping_cost",
        "estimated_return_rate",
    )
    if grain == "customer":
        return rows
    first = {"customer_state", "customer_city"}
    return rows.groupBy(PERSON).agg(*((F.min if c in first else F.max)(c).alias(c) for c in rows.columns if c != PERSON))


def recommendation_dataset(shop: Shop) -> DataFrame:
    """Delivered items per person and product."""
    return person_product_counts(shop).withColumnRenamed("total_purchases", "purchase_count")
