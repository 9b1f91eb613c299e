"""Shop tables over the star-schema sample data (region … lineitem, events)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.sources.shop import Shop

# Layout of the sample files. Stated, so that opening a table runs no job.
SAMPLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


class SampleTables:
    """Opens the sample files of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self._spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{self._dir}/{name}.parquet")


def _orders(table: SampleTables) -> DataFrame:
    # Grouped by its join key, so Catalyst drops this join for every query that
    # reads neither of the two dates.
    shipping = (
        table("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_shipdate").alias("order_delivered_carrier_date"),
            F.max("l_shipdate").alias("order_delivered_customer_date"),
        )
    )
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "P", "canceled")
        .when(F.col("o_orderpriority") == "1-URGENT", "processing")
        .otherwise("shipped")
    )
    return (
        table("orders")
        .join(shipping, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + _days(key % 3)).alias("order_approved_at"),
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            (F.col("o_orderdate") + _days(20 + key % 20)).alias("order_estimated_delivery_date"),
        )
    )


def _order_items(table: SampleTables) -> DataFrame:
    return table("lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        (F.col("l_tax") * 100).cast("decimal(10,2)").alias("freight_value"),
    )


def _nation_names(table: SampleTables) -> DataFrame:
    """Grouped by the join key too, so that queries without the state skip the join."""
    return table("nation").groupBy("n_nationkey").agg(F.max("n_name").alias("n_name"))


def _customers(table: SampleTables) -> DataFrame:
    return (
        table("customer")
        .join(_nation_names(table), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.expr("c_custkey div 2").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def _sellers(table: SampleTables) -> DataFrame:
    return (
        table("supplier")
        .join(_nation_names(table), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )


def _products(table: SampleTables) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        F.length("p_type").alias("product_description_length"),
        F.lit(1).alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
        size.alias("product_length_cm"),
        size.alias("product_height_cm"),
        size.alias("product_width_cm"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("product_category_name_english"),
    )


def _payments(table: SampleTables) -> DataFrame:
    return table("orders").select(
        F.col("o_orderkey").alias("payment_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("payment_type"),
        (F.col("o_orderkey") % 12 + 1).cast("int").alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("payment_value"),
        F.lit(1).alias("payment_sequential"),
    )


def _reviews(table: SampleTables) -> DataFrame:
    """Low-priority orders have no review and urgent ones have two."""
    key = F.col("o_orderkey")
    first = F.struct((key * 2).alias("review_id"), (key % 5 + 1).cast("int").alias("review_score"))
    second = F.struct((key * 2 + 1).alias("review_id"), F.lit(1).alias("review_score"))
    written = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(first, second)).when(
        F.col("o_orderpriority") != "5-LOW", F.array(first)
    )
    return (
        table("orders")
        .select("o_orderkey", "o_orderdate", F.inline(written))
        .select(
            "review_id",
            key.alias("order_id"),
            "review_score",
            F.lit("No Title").alias("review_comment_title"),
            F.lit("No Message").alias("review_comment_message"),
            (F.col("o_orderdate") + _days(F.lit(10))).alias("review_creation_date"),
            (F.col("o_orderdate") + _days(10 + key % 7)).alias("review_answer_timestamp"),
        )
    )


def _geolocation(table: SampleTables) -> DataFrame:
    """One region stays unmapped, which leaves zip prefixes for the backfill job."""
    return (
        table("nation")
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("r_name") != "AFRICA")
        .select(
            F.col("n_nationkey").alias("geolocation_zip_code_prefix"),
            F.col("n_regionkey").cast("double").alias("geolocation_lat"),
            F.col("n_nationkey").cast("double").alias("geolocation_lng"),
            F.col("r_name").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )
    )


def sample_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """Map the sample tables onto the shop model; a table is opened when it is used."""
    table = SampleTables(spark, sf_dir)
    return Shop(
        customers=partial(_customers, table),
        sellers=partial(_sellers, table),
        products=partial(_products, table),
        orders=partial(_orders, table),
        order_items=partial(_order_items, table),
        payments=partial(_payments, table),
        reviews=partial(_reviews, table),
        geolocation=partial(_geolocation, table),
    )


def event_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """Orders with a time of day: the sample orders are all placed at midnight."""
    return Shop(
        orders=SampleTables(spark, sf_dir)("events").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.col("event_type").alias("order_status"),
            F.col("ts").alias("order_purchase_timestamp"),
        )
    )


def faulty_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """The sample shop with missing parents, over-long names and over-large amounts."""
    shop, table = sample_shop(spark, sf_dir), SampleTables(spark, sf_dir)
    account = table("customer").select(F.col("c_custkey").alias("customer_id"), "c_name", "c_acctbal")
    customers = (
        shop.customers.join(account, "customer_id")
        .filter(F.col("c_acctbal") >= 0)
        .withColumn("customer_state", F.col("c_name"))
        .drop("c_name", "c_acctbal")
    )
    return shop.but(
        customers=customers,
        products=shop.products.filter(F.col("product_category_name") != "Brand#3"),
        payments=shop.payments.withColumn(
            "payment_value", F.col("payment_value").cast("decimal(14,2)") * 1000
        ),
    )


# --- raw tables with the faults that the cleaning jobs repair ---------------------------
#
# Keys repeat, times are text and partly not times, categories and texts are missing.


def _text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def raw_customers(table: SampleTables) -> DataFrame:
    """One row per order, so a customer repeats with every order."""
    return table("orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("customer_city"),
        F.col("o_orderkey").alias("ingest_order"),
    )


def raw_products(table: SampleTables) -> DataFrame:
    return table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_type").alias("product_description_lenght"),
        F.when(F.col("p_brand") != "Brand#2", F.col("p_brand")).alias("product_category_name"),
    )


def raw_translation(table: SampleTables) -> DataFrame:
    brands = table("part").select(F.col("p_brand").alias("product_category_name")).distinct()
    return brands.filter(~F.col("product_category_name").isin("Brand#2", "Brand#3")).withColumn(
        "product_category_name_english", F.upper("product_category_name")
    )


def raw_orders(table: SampleTables) -> DataFrame:
    """One row per item, so an order repeats as a whole."""
    placed = _text("o_orderdate")
    return (
        table("lineitem")
        .select("l_orderkey")
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            placed.alias("order_purchase_timestamp"),
            F.when(F.col("o_orderstatus") != "P", placed).otherwise("not a date").alias("order_approved_at"),
            F.when(F.col("o_orderstatus") == "F", placed).otherwise("").alias("order_delivered_carrier_date"),
            F.lit("soon").alias("order_delivered_customer_date"),
            placed.alias("order_estimated_delivery_date"),
        )
    )


def raw_order_items(table: SampleTables) -> DataFrame:
    shipped = F.when(F.col("l_returnflag") != "R", _text("l_shipdate")).otherwise("unknown")
    return table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("order_item_id"),
        shipped.alias("shipping_limit_date"),
    )


def raw_reviews(table: SampleTables) -> DataFrame:
    """One row per turn, so a review repeats with every turn of the conversation."""
    return table("conversations").select(
        F.col("conv_id").alias("review_id"),
        F.when(F.col("role") != "user", F.col("role")).alias("review_comment_title"),
        F.col("text").alias("review_comment_message"),
        F.lit("2018-01-02 03:04:05").alias("review_creation_date"),
        F.lit("never").alias("review_answer_timestamp"),
        F.struct("turn", "role", "text").alias("ingest_order"),
    )


def raw_scores(table: SampleTables) -> DataFrame:
    """Scores run from 1 to 7 here."""
    return table("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("review_score")
    )


def raw_geolocation(table: SampleTables) -> DataFrame:
    """One row per customer, so a zip prefix repeats."""
    return table("customer").select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        F.col("c_acctbal").alias("geolocation_lat"),
        F.col("c_custkey").alias("ingest_order"),
    )
