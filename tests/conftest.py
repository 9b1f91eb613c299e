from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from mercadia.session import local_session
from mercadia.sources.schemas import TABLES
from mercadia.sources.shop import Shop

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=8, partitions=4)


@pytest.fixture(scope="session")
def make_shop(spark):
    """Shop from rows given as dicts; missing columns are NULL, text times and money are typed."""

    def typed(value, kind: str):
        if value is None:
            return None
        if kind == "timestamp_ntz":
            return datetime.fromisoformat(value)
        return Decimal(str(value)) if kind.startswith("decimal") else value

    def make(**tables: list[dict]) -> Shop:
        frames = {}
        for name, schema in TABLES.items():
            rows = [
                tuple(typed(row.get(f.name), f.dataType.simpleString()) for f in schema.fields)
                for row in tables.get(name, [])
            ]
            frames[name] = spark.createDataFrame(rows, schema)
        return Shop(**frames)

    return make


@pytest.fixture(scope="session")
def order():
    def one(order_id, customer_id, bought, status="delivered", **more) -> dict:
        return {
            "order_id": order_id,
            "customer_id": customer_id,
            "order_status": status,
            "order_purchase_timestamp": bought,
            **more,
        }

    return one


@pytest.fixture(scope="session")
def item():
    def one(order_id, line=1, price=10, freight=1, product="p") -> dict:
        return {
            "order_id": order_id,
            "order_item_id": line,
            "product_id": product,
            "seller_id": "s",
            "price": price,
            "freight_value": freight,
        }

    return one


@pytest.fixture(scope="session")
def people():
    """One customer id per given person: {"c1": "alice", ...}."""

    def many(ids: dict) -> list[dict]:
        return [
            {"customer_id": c, "customer_unique_id": p, "customer_state": "SP", "customer_city": "x"}
            for c, p in ids.items()
        ]

    return many
