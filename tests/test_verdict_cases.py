"""Cases that once gave wrong results."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from mercadia.functions.params import Period
from mercadia.operators import features, kpis, quality
from mercadia.plans import facts
from mercadia.sources import warehouse

YEAR = Period.of_days(date(2018, 1, 1), date(2018, 12, 31))


def test_orders_of_unknown_customers_earn_nothing(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c1": "alice"}),
        orders=[order("o1", "c1", "2018-02-01"), order("o2", "nobody", "2018-02-02")],
        order_items=[item("o1", price=10, freight=0), item("o2", price=100, freight=0)],
    )
    for one in (shop, shop.but(order_fact=facts.build_order_fact(shop))):
        row = kpis.new_vs_returning_revenue(one, YEAR).first()
        assert (row["new_customer_revenue"], row["returning_customer_revenue"]) == (10.0, 0.0)


def test_cascade_never_adds_rows(make_shop, order, people):
    twice = people({"c1": "alice"}) * 2
    shop = make_shop(customers=twice, orders=[order("o1", "c1", "2018-02-01"), order("o2", "gone", "2018-02-01"), order("o3", None, "2018-02-01")])
    assert sorted(r["order_id"] for r in quality.cascade(shop).orders.collect()) == ["o1", "o3"]


def test_a_later_day_adds_to_the_feature_store(spark, tmp_path):
    rows = spark.range(2).select(F.lit("f").alias("feature_name"), F.col("id").cast("string").alias("feature_value"))
    path = str(tmp_path / "store")
    for day in (1, 2, 2):
        warehouse.save_features(rows.withColumn("computed_at", F.lit(datetime(2020, 1, day)).cast("timestamp_ntz")), path)
    stored = spark.read.parquet(path).groupBy("computed_date").count().collect()
    assert sorted(r["count"] for r in stored) == [2, 2]


def test_documents_have_the_same_grain_at_every_size(make_shop, order, item, people):
    for n in (3, 300):
        shop = make_shop(
            customers=people({"c1": "alice"}),
            orders=[order("o1", "c1", "2018-02-01")],
            order_items=[item("o1", line=k, product=f"p{k}") for k in range(n)],
        )
        assert features.purchase_documents(shop).count() == 1


def test_preferred_payment_type(make_shop, order, people):
    shop = make_shop(
        customers=people({"c1": "alice", "c2": "bob"}),
        orders=[order("o1", "c1", "2018-02-01"), order("o2", "c2", "2018-02-01")],
        payments=[
            {"order_id": o, "payment_sequential": k, "payment_type": t, "payment_installments": 1, "payment_value": 1}
            for k, (o, t) in enumerate([("o1", "card"), ("o1", "card"), ("o1", "slip"), ("o2", "slip"), ("o2", "card")])
        ],
    )
    found = {r[0]: (r[1], r[2]) for r in features.preferred_payment_types(shop).collect()}
    assert found == {"alice": ("card", 3), "bob": ("card", 2)}


def test_cleaned_orders_are_stored_by_month(make_shop, order, people, spark, tmp_path):
    shop = make_shop(customers=people({"c1": "a"}), orders=[order("o1", "c1", "2018-02-03"), order("o2", "c1", "2018-05-01")])
    warehouse.save_tables(shop, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/orders")
    plan = YEAR.keep(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
