"""Appending batches to stored tables: keys, parents, single tables, failures."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from mercadia.operators import quality
from mercadia.sources import warehouse
from mercadia.sources.shop import Shop


@pytest.fixture
def database(spark, tmp_path):
    name = f"loads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    warehouse.create_tables(spark, name)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture
def batch(make_shop, order, item, people):
    """A shop of the given tables only, out of orders {order: customer} and customers."""

    def make(customers=(), orders=None, items=None) -> Shop:
        whole = make_shop(
            customers=people({c: f"p-{c}" for c in customers}),
            orders=[order(o, c, "2018-01-01") for o, c in (orders or {}).items()],
            order_items=[item(o, line) for o, line in (items or ())],
            products=[{"product_id": "p"}],
            sellers=[{"seller_id": "s"}],
        )
        given = {"customers": customers, "orders": orders, "order_items": items}
        return Shop(**{name: getattr(whole, name) for name, rows in given.items() if rows})

    return make


@pytest.fixture
def base(make_shop, order, item, people, database):
    """One customer with one order of one item, stored."""
    shop = make_shop(
        customers=people({"c1": "alice"}),
        orders=[order("o1", "c1", "2018-01-01")],
        order_items=[item("o1", 1)],
        products=[{"product_id": "p"}],
        sellers=[{"seller_id": "s"}],
    )
    warehouse.load_tables(shop, database, load_id="first")
    return shop


def stored(spark, database) -> dict[str, int]:
    return {name: df.count() for name, df in warehouse.read_database(spark, database).tables().items()}


def test_stored_keys_are_refused(spark, database, base, batch):
    before = stored(spark, database)
    with pytest.raises(ValueError, match="stored key of customers: 1 rows"):
        warehouse.load_tables(base, database)
    with pytest.raises(ValueError, match="stored key of order_items: 1 rows"):
        warehouse.load_tables(batch(orders={"o2": "c1"}, items=[("o1", 1), ("o1", 2)]), database)
    assert stored(spark, database) == before


def test_stored_parents_are_accepted(spark, database, base, batch):
    warehouse.load_tables(batch(orders={"o2": "c1"}, items=[("o1", 2), ("o2", 1)]), database)
    found = stored(spark, database)
    assert (found["customers"], found["orders"], found["order_items"]) == (1, 2, 3)
    with pytest.raises(ValueError, match="parent of orders.customer_id: 1 rows"):
        warehouse.load_tables(batch(orders={"o3": "nobody", "o4": "c1"}), database)


def test_a_batch_of_one_table(spark, database, base, batch):
    warehouse.load_tables(batch(customers=["c2", "c3"]), database)
    assert stored(spark, database)["customers"] == 3
    with pytest.raises(ValueError, match="key of customers: 2 rows"):
        twice = batch(customers=["c4"]).customers
        warehouse.load_tables(Shop(customers=twice.unionByName(twice)), database)
    assert quality.orphan_report(batch(customers=["c9"])).count() == 0


def test_a_failed_load_is_invisible_and_runs_again(spark, database, base, batch):
    good = batch(customers=["c2"], orders={"o2": "c2"}, items=[("o2", 1)])
    failing = good.but(
        order_items=good.order_items.withColumn("seller_id", F.raise_error(F.lit("lost")).cast("string"))
    )
    before = stored(spark, database)
    with pytest.raises(Exception, match="lost"):
        warehouse.load_tables(failing, database, check=False, load_id="second")
    # Customers and orders are written, but the load did not end.
    assert spark.table(f"{database}.orders").count() == 2
    assert stored(spark, database) == before
    for _ in range(2):
        assert warehouse.load_tables(good, database, load_id="second") == "second"
    found = stored(spark, database)
    assert (found["customers"], found["orders"], found["order_items"]) == (2, 2, 2)
    assert spark.table(f"{database}.orders").count() == 2


def test_failed_loads_are_dropped_on_request(spark, database, base, batch):
    good = batch(customers=["c2"], orders={"o2": "c2"})
    failing = good.but(orders=good.orders.withColumn("order_status", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        warehouse.load_tables(failing, database, check=False)
    assert spark.table(f"{database}.customers").count() == 2
    warehouse.drop_failed_loads(spark, database)
    assert spark.table(f"{database}.customers").count() == 1


def test_the_store_is_pruned_by_the_keys_of_a_batch(spark, database, base, batch):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    kept = {key: spark.conf.get(key) for key in settings}
    store = warehouse.read_database(spark, database).customers
    path = f"{database}.batch"
    batch(customers=["c1", "c7"]).customers.write.saveAsTable(path)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = quality.stored_keys(store, "customer_id", spark.table(path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan and ">= c1" in plan and "<= c7" in plan
        assert [r.customer_id for r in found.collect()] == ["c1"]
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
