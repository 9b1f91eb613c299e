"""One key with a third of all rows: results must be whole, checked by brute force."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from mercadia.functions.params import Period
from mercadia.operators import customers, features, products
from mercadia.plans import facts


@pytest.fixture(scope="module")
def hot(make_shop, order, item, people):
    """A third of the orders belong to one person, a third of the items to one order."""
    rng = random.Random(7)
    ids = {f"c{i}": ("hot" if i < 5 else f"p{i // 2}") for i in range(60)}
    orders, items = [], []
    for n in range(600):
        buyer = rng.choice(["c0", "c1", "c2", "c3", "c4"]) if n % 3 == 0 else f"c{rng.randrange(5, 60)}"
        bought = datetime(2020, 1, 1) + timedelta(minutes=rng.randrange(90 * 24 * 60))
        status = rng.choice(["delivered", "delivered", "canceled", "shipped"])
        orders.append(order(f"o{n}", buyer, bought.isoformat(" "), status))
        lines = 300 if n == 0 else rng.randrange(4)
        items += [
            item(f"o{n}", line + 1, rng.randrange(1, 9999) / 100, rng.randrange(99) / 100, f"x{rng.randrange(40)}")
            for line in range(lines)
        ]
    return ids, orders, items, make_shop(customers=people(ids), orders=orders, order_items=items)


def test_gaps_by_brute_force(hot):
    ids, orders, _, shop = hot
    times = defaultdict(list)
    for o in orders:
        times[ids[o["customer_id"]]].append(datetime.fromisoformat(o["order_purchase_timestamp"]))
    expected = {}
    for person, moments in times.items():
        moments.sort()
        gaps = [(b - a).days for a, b in zip(moments, moments[1:])]
        expected[person] = sum(gaps) / len(gaps) if gaps else 9999.0
    found = features.order_gaps(shop, delivered_only=False, single_order_default=9999)
    assert {r[0]: r[1] for r in found.collect()} == expected


def test_purchase_documents_split_and_stay_whole(hot):
    ids, orders, items, shop = hot
    status = {o["order_id"]: (o["order_status"], ids[o["customer_id"]]) for o in orders}
    expected = Counter()
    for i in items:
        kind, person = status[i["order_id"]]
        if kind == "delivered":
            expected[person, i["product_id"]] += 1
    found, documents = Counter(), Counter()
    for row in features.purchase_documents(shop, parts=4).collect():
        documents[row["customer_unique_id"]] += 1
        for entry in json.loads(row["product_purchases"]):
            found[row["customer_unique_id"], entry["product_id"]] += entry["total_purchases"]
    assert found == expected
    assert documents["hot"] > 1
    single = features.purchase_documents(shop).groupBy("customer_unique_id").count()
    assert {r["count"] for r in single.collect()} == {1}


def test_results_do_not_depend_on_partitions(hot, spark):
    shop = hot[-1]
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def snapshot():
        frames = (features.update_customers(shop), customers.customer_rfm(shop))
        return [sorted(map(str, df.collect())) for df in frames]

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = snapshot()
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert snapshot() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def scaled_down(spark):
    """Thresholds of the skew split scaled down to the fixture."""
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_order_is_split_at_item_grain(hot, scaled_down):
    """AQE splits the hot order's partition."""
    shop = hot[-1]
    expected = Counter()
    status = {o["order_id"]: o["order_status"] for o in hot[1]}
    for i in hot[2]:
        expected[i["product_id"]] += status[i["order_id"]] == "delivered"
    df = features.product_popularity(shop.but(order_items=shop.order_items.repartition(8)))
    assert {r["product_id"]: r["total_sales"] for r in df.collect()} == {k: n for k, n in expected.items() if n}
    assert "skew=true" in executed(df)


YEAR = Period.of_days(date(2020, 1, 1), date(2020, 12, 31))


@pytest.fixture(scope="module")
def reviewed(hot, make_shop):
    """The hot shop with products of four categories and 0 to 3 reviews per order."""
    rng = random.Random(9)
    _, orders, items, shop = hot
    reviews = [
        {"review_id": f"r{o['order_id']}-{k}", "order_id": o["order_id"], "review_score": rng.randrange(1, 6)}
        for o in orders
        for k in range(rng.randrange(4))
    ]
    names = [{"product_id": f"x{k}", "product_category_name_english": [None, "a", "b", "c"][k % 4]} for k in range(40)]
    more = make_shop(reviews=reviews, products=names)
    whole = shop.but(reviews=more.reviews, products=more.products)
    return orders, items, reviews, whole


def brute_matrix(orders, items, reviews) -> dict[str, tuple]:
    status = {o["order_id"]: o["order_status"] for o in orders}
    scores = defaultdict(list)
    for r in reviews:
        scores[r["order_id"]].append(r["review_score"])
    revenue, units, seen, all_, canceled = Counter(), defaultdict(set), defaultdict(list), Counter(), Counter()
    for i in items:
        category = [None, "a", "b", "c"][int(i["product_id"][1:]) % 4]
        if category is None:
            continue
        kind, own = status[i["order_id"]], scores[i["order_id"]]
        all_[category] += 1
        canceled[category] += kind == "canceled"
        if kind == "delivered":
            revenue[category] += round((i["price"] + i["freight_value"]) * 100) * max(1, len(own))
            units[category].add(i["order_item_id"])
            seen[category] += own
    return {
        c: (revenue[c] / 100, len(units[c]), sum(seen[c]) / len(seen[c]), 100 * canceled[c] / all_[c]) for c in units
    }


def rounded(rows) -> dict[str, tuple]:
    return {r[0]: tuple(round(v, 6) for v in r[1:]) for r in rows}


def test_categories_of_a_hot_order(reviewed, scaled_down):
    """One join of the items, split at the hot order; nothing shuffles items after it."""
    orders, items, reviews, shop = reviewed
    expected = {c: tuple(round(v, 6) for v in row) for c, row in brute_matrix(orders, items, reviews).items()}
    shop = shop.but(order_items=shop.order_items.repartition(8))
    performance, matrix = products.category_performance(shop, YEAR), products.category_matrix(shop, YEAR)
    assert rounded(performance.collect()) == {c: row[:3] for c, row in expected.items()}
    assert rounded(matrix.collect()) == expected
    for df in (performance, matrix):
        plan = executed(df).partition("Initial Plan")[0]
        assert "skew=true" in plan
        # Items are shuffled to their orders, and then only as sums per product and line.
        shuffles = [line for line in plan.splitlines() if " Exchange " in line]
        assert sum("hashpartitioning(order_id" in line and "REPARTITION" not in line for line in shuffles) <= 4
        assert plan.count("order_item_id") and "skew=true" in plan


def test_categories_from_facts_of_a_hot_order(reviewed):
    orders, items, reviews, shop = reviewed
    stored = shop.but(sales_fact=facts.build_sales_fact(shop), order_fact=facts.build_order_fact(shop))
    expected = {c: tuple(round(v, 6) for v in row) for c, row in brute_matrix(orders, items, reviews).items()}
    assert rounded(products.category_matrix(stored, YEAR).collect()) == expected


def test_roll_up_folds_the_hot_person(hot):
    _, orders, _, shop = hot
    counted = facts.roll_up(shop, shop.orders.selectExpr("*", "1 AS n"), facts.PERSON, sums=("n",))
    assert sum(r["n"] for r in counted.collect()) == len(orders)
