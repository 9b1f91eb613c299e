"""Explicit schemas: the eight shop tables, the raw CSV files and the model data sets."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
MONEY, MOMENT, DATE = T.DecimalType(10, 2), T.TimestampNTZType(), T.DateType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Table and column names, types and widths of the shop data model.
TABLES: dict[str, T.StructType] = {
    "geolocation": _struct(
        geolocation_zip_code_prefix=INT,
        geolocation_lat=DOUBLE,
        geolocation_lng=DOUBLE,
        geolocation_city=STRING,
        geolocation_state=STRING,
    ),
    "customers": _struct(
        customer_id=STRING,
        customer_unique_id=STRING,
        customer_zip_code_prefix=INT,
        customer_city=STRING,
        customer_state=STRING,
    ),
    "sellers": _struct(
        seller_id=STRING,
        seller_zip_code_prefix=INT,
        seller_city=STRING,
        seller_state=STRING,
    ),
    "products": _struct(
        product_id=STRING,
        product_category_name=STRING,
        product_name_length=INT,
        product_description_length=INT,
        product_photos_qty=INT,
        product_weight_g=DOUBLE,
        product_length_cm=DOUBLE,
        product_height_cm=DOUBLE,
        product_width_cm=DOUBLE,
        product_category_name_english=STRING,
    ),
    "orders": _struct(
        order_id=STRING,
        customer_id=STRING,
        order_status=STRING,
        order_purchase_timestamp=MOMENT,
        order_approved_at=MOMENT,
        order_delivered_carrier_date=MOMENT,
        order_delivered_customer_date=MOMENT,
        order_estimated_delivery_date=MOMENT,
    ),
    "order_items": _struct(
        order_item_id=LONG,
        order_id=STRING,
        product_id=STRING,
        seller_id=STRING,
        shipping_limit_date=MOMENT,
        price=MONEY,
        freight_value=MONEY,
    ),
    "payments": _struct(
        payment_id=LONG,
        order_id=STRING,
        payment_type=STRING,
        payment_installments=INT,
        payment_value=MONEY,
        payment_sequential=INT,
    ),
    "reviews": _struct(
        review_id=STRING,
        order_id=STRING,
        review_score=INT,
        review_comment_title=STRING,
        review_comment_message=STRING,
        review_creation_date=MOMENT,
        review_answer_timestamp=MOMENT,
    ),
}

# The registry above is already in an order in which foreign keys can be loaded.
LOAD_ORDER = tuple(TABLES)

PRIMARY_KEYS = {
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "payments": "payment_id",
    "reviews": "review_id",
    "geolocation": "geolocation_zip_code_prefix",
}

# What identifies a row. A line number alone repeats.
ROW_KEYS = {name: (key,) for name, key in PRIMARY_KEYS.items()} | {"order_items": ("order_id", "order_item_id")}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
)

# Declared character widths.
WIDTHS = {
    "customers": {"customer_id": 50, "customer_unique_id": 50, "customer_city": 255, "customer_state": 10},
    "sellers": {"seller_id": 50, "seller_city": 255, "seller_state": 10},
    "products": {"product_id": 50, "product_category_name": 255},
    "orders": {"order_id": 50, "customer_id": 50, "order_status": 50},
    "order_items": {"order_id": 50, "product_id": 50, "seller_id": 50},
    "payments": {"order_id": 50, "payment_type": 50},
    "reviews": {"review_id": 50, "order_id": 50},
    "geolocation": {"geolocation_city": 255, "geolocation_state": 10},
}

MONEY_COLUMNS = {"order_items": ("price", "freight_value"), "payments": ("payment_value",)}

# Raw file names and the raw columns that differ from the tables above.
# Timestamps arrive as text and are parsed by the cleaning jobs.
RAW_FILES = {
    "customers": "olist_customers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
}
RAW_MISSPELT = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}


def _raw(table: str, drop: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> T.StructType:
    """Raw layout of a table: timestamps as text, listed columns first, some absent."""
    fields = {f.name: f for f in TABLES[table].fields if f.name not in drop}
    names = [*first, *(n for n in fields if n not in first)]
    misspelt = {good: bad for bad, good in RAW_MISSPELT.items()}
    return T.StructType(
        [
            T.StructField(misspelt.get(n, n), STRING if fields[n].dataType == MOMENT else fields[n].dataType)
            for n in names
        ]
    )


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _raw("customers"),
    "products": _raw("products", drop=("product_category_name_english",)),
    "category_translation": _struct(product_category_name=STRING, product_category_name_english=STRING),
    "orders": _raw("orders"),
    "order_items": _raw("order_items", first=("order_id",)),
    "payments": _raw(
        "payments",
        drop=("payment_id",),
        first=("order_id", "payment_sequential", "payment_type", "payment_installments"),
    ),
    "reviews": _raw("reviews"),
    "geolocation": _raw("geolocation"),
    "sellers": _raw("sellers"),
}

# Columns that the table updates add, and those of the data sets.
CUSTOMER_FEATURES = _struct(
    clv=DOUBLE,
    avg_days_between_orders=DOUBLE,
    total_orders=INT,
    avg_order_value=DOUBLE,
    avg_shipping_cost=DOUBLE,
    estimated_return_rate=DOUBLE,
)

DATASETS: dict[str, T.StructType] = {
    "forecasting": _struct(ds=DATE, y=DOUBLE),
    "segmentation": T.StructType(
        [
            T.StructField("customer_unique_id", STRING),
            T.StructField("customer_state", STRING),
            T.StructField("customer_city", STRING),
            T.StructField("clv", DOUBLE),
            T.StructField("total_orders", INT),
            T.StructField("avg_order_value", DOUBLE),
            T.StructField("avg_days_between_orders", DOUBLE),
            T.StructField("avg_shipping_cost", DOUBLE),
            T.StructField("estimated_return_rate", DOUBLE),
        ]
    ),
    "recommendation": _struct(customer_unique_id=STRING, product_id=STRING, purchase_count=LONG),
}
