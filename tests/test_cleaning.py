"""The raw CSV zone through cleaning, loading and checking."""

from __future__ import annotations

import csv
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mercadia.operators import cleaning, quality
from mercadia.plans import pipelines
from mercadia.sources import raw_csv, warehouse
from mercadia.sources.schemas import RAW_FILES, RAW_SCHEMAS, TABLES
from mercadia.sources.shop import Shop

RAW = {
    "customers": [
        ("c1", "p1", 10, "first", "SP"),
        ("c2", "p1", 11, "x", "SP"),
        ("c1", "p9", 12, "second", "RJ"),
    ],
    "products": [
        ("x1", "brinquedos", 5, 7, 1, 10.5, 1.0, 2.0, 3.0),
        ("x2", None, None, None, None, None, None, None, None),
        ("x3", "sem_nome", 1, 1, 1, 1.0, 1.0, 1.0, 1.0),
    ],
    "category_translation": [("brinquedos", "toys")],
    "orders": [
        ("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-01 11:00:00", "", "oops", "2018-02-01 00:00:00"),
        ("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-01 11:00:00", "", "oops", "2018-02-01 00:00:00"),
        ("o2", None, "shipped", "2018-01-02 10:00:00", None, None, None, "2018-02-01 00:00:00"),
        ("o3", "gone", "shipped", "2018-01-03 10:00:00", None, None, None, "2018-02-01 00:00:00"),
    ],
    "order_items": [
        ("o1", 1, "x1", "s1", "2018-01-05 00:00:00", "10.50", "1.25"),
        ("o1", 2, "x2", "s1", "tomorrow", "0.99", "0.01"),
        ("o3", 1, "x1", "s1", "2018-01-05 00:00:00", "1.00", "1.00"),
    ],
    "payments": [("o1", 1, "credit_card", 3, "12.75")],
    "reviews": [
        ("r1", "o1", 5, None, 'said "great",\nthen left', "2018-01-09 00:00:00", "2018-01-11 05:00:00"),
        ("r1", "o1", 1, "late", "copy", "2018-01-09 00:00:00", "2018-01-11 05:00:00"),
        ("r2", "o1", 4, "ok", None, "2018-01-09 00:00:00", "never"),
    ],
    "geolocation": [(10, -1.5, 2.5, "first", "SP"), (10, 9.0, 9.0, "second", "SP")],
    "sellers": [("s1", 20, "y", "SP"), ("s2", 11, "y", "SP")],
}


@pytest.fixture(scope="module")
def raw_path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for table, rows in RAW.items():
        with open(folder / RAW_FILES[table], "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(RAW_SCHEMAS[table].fieldNames())
            writer.writerows(rows)
    return str(folder)


@pytest.fixture(scope="module")
def cleaned(spark, raw_path, tmp_path_factory) -> Shop:
    return pipelines.run_cleaning(spark, raw_path, str(tmp_path_factory.mktemp("cleaned") / "zone"))


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_first_row_of_a_key_stays(cleaned):
    assert by_key(cleaned.customers, "customer_id")["c1"]["customer_city"] == "first"
    assert cleaned.customers.count() == 2
    assert by_key(cleaned.geolocation, "geolocation_zip_code_prefix")[10]["geolocation_city"] == "first"


def test_first_row_across_many_splits(spark, tmp_path):
    """File order decides, also when one file is read by many tasks."""
    folder = tmp_path / RAW_FILES["customers"]
    folder.mkdir()
    for part in range(3):
        with open(folder / f"part-{part}.csv", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(RAW_SCHEMAS["customers"].fieldNames())
            writer.writerows((f"c{n % 50}", f"{part}-{n}", n, "x", "SP") for n in range(2000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = raw_csv.read_raw(spark, str(tmp_path), "customers", ingest_order=True)
        assert raw.rdd.getNumPartitions() > 6
        first = cleaning.clean_customers(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["customer_unique_id"] for r in first} == {f"0-{n}" for n in range(50)}


def test_products_are_named_and_translated(cleaned):
    found = by_key(cleaned.products, "product_id")
    assert found["x1"]["product_category_name_english"] == "toys"
    assert found["x1"]["product_name_length"] == 5 and found["x1"]["product_description_length"] == 7
    assert found["x2"]["product_category_name"] == "unknown"
    assert found["x2"]["product_category_name_english"] is None
    assert found["x3"]["product_category_name_english"] is None


def test_orders_lose_copies_bad_times_and_customerless_rows(cleaned):
    found = by_key(cleaned.orders, "order_id")
    assert set(found) == {"o1", "o3"} and cleaned.orders.count() == 2
    assert found["o1"]["order_purchase_timestamp"] == datetime(2018, 1, 1, 10)
    assert found["o1"]["order_delivered_carrier_date"] is None
    assert found["o1"]["order_delivered_customer_date"] is None


def test_a_bad_purchase_time_is_an_error(spark):
    row = RAW["orders"][0]
    bad = spark.createDataFrame([(*row[:3], "yesterday", *row[4:])], RAW_SCHEMAS["orders"])
    with pytest.raises(PySparkException):
        cleaning.clean_orders(bad).collect()


def test_items_and_reviews(cleaned):
    limits = {r["order_item_id"]: r["shipping_limit_date"] for r in cleaned.order_items.collect()}
    assert limits[2] is None and limits[1] == datetime(2018, 1, 5)
    found = by_key(cleaned.reviews, "review_id")
    assert found["r1"]["review_score"] == 5
    assert found["r1"]["review_comment_title"] == "No Title"
    assert found["r1"]["review_comment_message"] == 'said "great",\nthen left'
    assert found["r2"]["review_comment_message"] == "No Message"
    assert found["r2"]["review_answer_timestamp"] is None


def test_each_unknown_zip_is_added_once(cleaned):
    found = by_key(cleaned.geolocation, "geolocation_zip_code_prefix")
    assert set(found) == {10, 11, 20} and cleaned.geolocation.count() == 3
    assert found[11]["geolocation_city"] == "Unknown" and found[20]["geolocation_state"] == "XX"
    assert found[11]["geolocation_lat"] is None


def test_tables_have_the_declared_types(cleaned):
    for name, df in cleaned.tables().items():
        # The folders of months add a column to the orders.
        assert [(f.name, f.dataType) for f in df.drop("purchase_month").schema] == [(f.name, f.dataType) for f in TABLES[name]]


def test_orphans_and_cascade(cleaned):
    report = by_key(quality.orphan_report(cleaned), "reference")
    assert report["orders.customer_id"]["orphan_rows"] == 1
    assert report["order_items.order_id"]["orphan_rows"] == 0
    kept = quality.cascade(cleaned)
    assert {r["order_id"] for r in kept.orders.collect()} == {"o1"}
    # The item of the dropped order goes with it.
    assert {r["order_id"] for r in kept.order_items.collect()} == {"o1"}
    assert kept.reviews.count() == 2


def test_a_null_reference_is_no_orphan(make_shop, order):
    shop = make_shop(customers=[], orders=[order("a", None, "2020-01-01 00:00:00")])
    assert by_key(quality.orphan_report(shop), "reference")["orders.customer_id"]["orphan_rows"] == 0
    assert quality.cascade(shop).orders.count() == 1


def test_keys_scores_and_widths(make_shop):
    shop = make_shop(
        customers=[{"customer_id": k, "customer_state": "S" * 11} for k in ("a", "a", None)],
        reviews=[{"review_id": str(s), "review_score": s} for s in (0, 1, 5, 6, None)],
    )
    keys = by_key(quality.key_report(shop), "table_name")["customers"]
    assert (keys["bad_keys"], keys["bad_rows"]) == (2, 3)
    assert {r["review_score"] for r in quality.score_violations(shop.reviews).collect()} == {0, 6}
    widths = {(r["table_name"], r["column_name"]): r["violations"] for r in quality.width_report(shop).collect()}
    assert widths["customers", "customer_state"] == 3
    assert widths["customers", "customer_id"] == 0


def test_tables_load_into_a_database_and_back(spark, cleaned, tmp_path):
    database = "shop_load_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{tmp_path}/db'")
    try:
        warehouse.create_tables(spark, database)
        with pytest.raises(ValueError, match="parent of orders.customer_id: 1 rows"):
            warehouse.load_tables(cleaned, database)
        warehouse.load_tables(quality.cascade(cleaned), database)
        warehouse.load_tables(Shop(customers=cleaned.customers), database, check=False)
        stored = warehouse.read_database(spark, database)
        assert stored.customers.count() == 2 * cleaned.customers.count()
        assert {r["order_id"] for r in stored.orders.collect()} == {"o1"}
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_cleaned_csv_round_trip(spark, cleaned, tmp_path):
    warehouse.save_csv(cleaned.reviews, f"{tmp_path}/reviews_cleaned.csv")
    back = raw_csv.read_cleaned_csv(spark, str(tmp_path), "reviews")
    assert sorted(map(str, back.collect())) == sorted(map(str, cleaned.reviews.collect()))


def test_views(spark, cleaned):
    cleaned.register_views("test_")
    assert spark.table("test_orders").filter(F.col("order_id") == "o1").count() == 1
