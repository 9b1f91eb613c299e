"""Cleaning jobs from the raw to the cleaned zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.sources.schemas import RAW_MISSPELT

UNKNOWN_CATEGORY = "unknown"
NO_TITLE, NO_MESSAGE = "No Title", "No Message"
UNKNOWN_CITY, UNKNOWN_STATE = "Unknown", "XX"

STRICT_ORDER_TIMES = ("order_purchase_timestamp", "order_estimated_delivery_date")
LENIENT_ORDER_TIMES = (
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
)


def keep_first(df: DataFrame, key: str, order: str = "ingest_order") -> DataFrame:
    """First row of each key in file order, without the column that holds the order.

    Spark prunes to one row per key and task before the shuffle, so a key that fills
    half the file costs nothing extra.
    """
    in_order = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(in_order)).filter("_rank = 1").drop("_rank", order)


def strict_timestamp(column: str) -> Column:
    """Parse text; a bad value is an error under ANSI mode, which is Spark's default."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def lenient_timestamp(column: str) -> Column:
    """Parse text; a bad value becomes NULL."""
    return F.col(column).try_cast("timestamp_ntz").alias(column)


def _replace(df: DataFrame, *parsed: tuple[str, Column]) -> DataFrame:
    return df.withColumns(dict(parsed))


def clean_customers(raw: DataFrame) -> DataFrame:
    return keep_first(raw, "customer_id")


def clean_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """Correct two column names, name missing categories, add the English category."""
    named = raw.withColumnsRenamed(RAW_MISSPELT).na.fill({"product_category_name": UNKNOWN_CATEGORY})
    english = translation.select("product_category_name", "product_category_name_english")
    return named.join(english, "product_category_name", "left")


def clean_orders(raw: DataFrame) -> DataFrame:
    """Drop repeated rows, parse the five times, drop orders without a customer."""
    times = [(c, strict_timestamp(c)) for c in STRICT_ORDER_TIMES]
    times += [(c, lenient_timestamp(c)) for c in LENIENT_ORDER_TIMES]
    return _replace(raw.dropDuplicates(), *times).na.drop(subset=["customer_id"])


def clean_order_items(raw: DataFrame) -> DataFrame:
    return _replace(raw, ("shipping_limit_date", lenient_timestamp("shipping_limit_date")))


def clean_reviews(raw: DataFrame) -> DataFrame:
    """First row per review, lenient times, default texts."""
    times = [(c, lenient_timestamp(c)) for c in ("review_creation_date", "review_answer_timestamp")]
    return _replace(keep_first(raw, "review_id"), *times).na.fill(
        {"review_comment_title": NO_TITLE, "review_comment_message": NO_MESSAGE}
    )


def clean_geolocation(raw: DataFrame) -> DataFrame:
    return keep_first(raw, "geolocation_zip_code_prefix")


def passed_through(raw: DataFrame) -> DataFrame:
    """Payments and sellers need no cleaning beyond their types."""
    return raw


def fix_missing_zip_codes(geolocation: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Add a placeholder row for each customer or seller zip prefix that has no location."""
    zip_code = "geolocation_zip_code_prefix"
    used = (
        customers.select(F.col("customer_zip_code_prefix").alias(zip_code))
        .union(sellers.select("seller_zip_code_prefix"))
        .distinct()
    )
    nowhere = F.lit(None).cast("double")
    missing = used.join(geolocation.select(zip_code), zip_code, "left_anti").select(
        zip_code,
        nowhere.alias("geolocation_lat"),
        nowhere.alias("geolocation_lng"),
        F.lit(UNKNOWN_CITY).alias("geolocation_city"),
        F.lit(UNKNOWN_STATE).alias("geolocation_state"),
    )
    return geolocation.unionByName(missing)
