"""Versions of derived tables: readers, re-runs after a failure, old versions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mercadia.plans import pipelines
from mercadia.sources import versions


@pytest.fixture
def shop(make_shop, order, item, people):
    return make_shop(
        customers=people({"c1": "alice", "c2": "bob"}),
        orders=[order("o1", "c1", "2018-02-01"), order("o2", "c2", "2018-03-01")],
        order_items=[item("o1"), item("o2", price=20)],
        products=[{"product_id": "p", "product_category_name": "toys"}],
        sellers=[{"seller_id": "s"}],
    )


def rows(df):
    return sorted(map(str, df.collect()))


def test_readers_of_an_old_version_survive(spark, shop, order, tmp_path):
    path = str(tmp_path)
    pipelines.run_features(shop, path, datetime(2020, 1, 1))
    old = versions.read_current(spark, path, "customers")
    before = rows(old)
    pipelines.run_features(shop.but(order_items=shop.order_items.withColumn("price", F.col("price") * 2)), path, datetime(2020, 1, 2))
    assert rows(old) == before
    assert rows(versions.read_current(spark, path, "customers")) != before
    assert versions.versions(spark, path) == ["20200101T000000", "20200102T000000"]
    assert versions.drop_old_versions(spark, path) == ["20200101T000000"]
    assert versions.read_current(spark, path, "orders").count() == 2


def test_a_failed_run_changes_nothing_and_runs_again(spark, shop, tmp_path):
    path = str(tmp_path)
    pipelines.run_features(shop, path, datetime(2020, 1, 1))
    before = rows(versions.read_current(spark, path, "customers"))
    broken = shop.but(products=shop.products.withColumn("product_weight_g", F.raise_error(F.lit("lost")).cast("double")))
    changed = broken.but(order_items=shop.order_items.withColumn("price", F.col("price") * 2))
    with pytest.raises(Exception, match="lost"):
        pipelines.run_features(changed, path, datetime(2020, 1, 2))
    # The new customers are written, but not current.
    assert spark.read.parquet(f"{path}/version=20200102T000000/customers").count() == 2
    assert rows(versions.read_current(spark, path, "customers")) == before
    mended = changed.but(products=shop.products)
    pipelines.run_features(mended, path, datetime(2020, 1, 2))
    after = rows(versions.read_current(spark, path, "customers"))
    assert after != before
    pipelines.run_features(shop, path, datetime(2020, 1, 2))
    assert rows(versions.read_current(spark, path, "customers")) == after
    assert versions.versions(spark, path) == ["20200101T000000", "20200102T000000"]


def test_failed_versions_are_dropped_on_request(spark, tmp_path):
    path = str(tmp_path)

    def fail(folder: str) -> None:
        spark.range(3).write.parquet(f"{folder}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, "a", fail)
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, path, "t")
    versions.publish(spark, path, "b", lambda folder: spark.range(5).write.parquet(f"{folder}/t"))
    assert versions.drop_old_versions(spark, path) == ["a"]
    assert versions.read_current(spark, path, "t").count() == 5
