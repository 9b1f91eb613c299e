"""Edge cases of periods, rankings, gaps and NULLs on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from mercadia.functions.params import Period
from mercadia.operators import customers, features, kpis, logistics, orders, products

YEAR = Period.of_days(date(2020, 1, 1), date(2020, 12, 31))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_period_bounds_are_closed_to_the_microsecond(make_shop, order):
    shop = make_shop(
        orders=[
            order("a", "c", "2020-12-31 23:59:59.999999"),
            order("b", "c", "2020-01-01 00:00:00"),
            order("c", "c", "2019-12-31 23:59:59.999999"),
            order("d", "c", "2021-01-01 00:00:00"),
        ]
    )
    assert rows(orders.orders_over_time(shop, YEAR, "year"))[0][1] == 2


def test_previous_period_leaves_out_the_last_second():
    previous = YEAR.previous()
    assert previous.end == datetime(2019, 12, 31, 23, 59, 59)
    assert datetime(2019, 12, 31, 23, 59, 59, 500000) not in previous
    assert YEAR.start - previous.start == YEAR.end - YEAR.start


def test_default_period_is_the_last_365_days(make_shop, order):
    shop = make_shop(orders=[order("a", "c", "2020-03-01 10:00:00"), order("b", "c", "2018-03-01 10:00:00")])
    assert Period.last_year_of(shop.orders) == Period.of_days(date(2019, 3, 2), date(2020, 3, 1))


def test_granularity_is_checked(make_shop):
    with pytest.raises(ValueError):
        orders.orders_over_time(make_shop(), YEAR, "hour")


def test_empty_period(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c": "p"}), orders=[order("a", "c", "2018-01-01 00:00:00")], order_items=[item("a")]
    )
    assert rows(kpis.main_kpis(shop, YEAR)) == [(0, None, None, 0, 0)]
    assert rows(kpis.new_customer_rate(shop, YEAR)) == [(0, 0, 0.0)]
    assert rows(kpis.gross_margin(shop, YEAR)) == [(None, None, None, 0.0)]
    assert rows(customers.repeat_rate(shop, YEAR)) == [(0.0,)]
    assert rows(orders.order_date_range(make_shop())) == [(None, None)]


def test_every_active_customer_counts_as_new_in_the_headline(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c1": "p", "c2": "p", "c3": "q", "c4": None}),
        orders=[
            order("old", "c1", "2018-01-01 00:00:00"),
            order("a", "c2", "2020-01-01 00:00:00"),
            order("b", "c3", "2020-02-01 00:00:00"),
            order("n", "c4", "2020-03-01 00:00:00"),
            order("x", "c3", "2020-04-01 00:00:00", status="canceled"),
            order("empty", "c3", "2020-05-01 00:00:00"),
        ],
        order_items=[item(o) for o in ("old", "a", "b", "n", "x")],
    )
    # The unknown person counts in orders and revenue, not among the customers.
    assert rows(kpis.main_kpis(shop, YEAR)) == [(3, 33.0, 11.0, 2, 2)]


def test_first_orders_are_ranked_over_history_with_ties(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c1": "p", "c2": "q"}),
        orders=[
            order("p1", "c1", "2019-06-01 00:00:00"),
            order("p2", "c1", "2020-01-05 00:00:00"),
            order("q1", "c2", "2020-01-05 00:00:00"),
            order("q2", "c2", "2020-01-05 00:00:00"),
            order("q0", "c2", "2019-01-05 00:00:00", status="canceled"),
        ],
        order_items=[item("p1", price=1), item("p2", price=2), item("q1", price=4), item("q2", price=8)],
    )
    (month,) = rows(
        kpis.new_vs_returning_revenue(shop, YEAR), "new_customer_revenue", "returning_customer_revenue"
    )
    assert month == (5.0, 12.0)


def test_gaps_between_orders(make_shop, order, people):
    shop = make_shop(
        customers=people({"c1": "once", "c2": "twice", "c3": "same", "c4": "thrice", "c5": "untimed"}),
        orders=[
            order("a", "c1", "2020-01-01 00:00:00"),
            order("b", "c2", "2020-01-01 12:00:00"),
            order("c", "c2", "2020-01-03 11:59:59"),
            order("d", "c3", "2020-01-01 08:00:00"),
            order("e", "c3", "2020-01-01 08:00:00"),
            order("f", "c4", "2020-01-01 23:00:00"),
            order("g", "c4", "2020-01-02 01:00:00", status="shipped"),
            order("h", "c4", "2020-01-12 22:59:59"),
            order("i", "c5", None),
        ],
    )
    gap = "avg_days_between_orders"
    everything = dict(rows(features.order_gaps(shop, delivered_only=False, single_order_default=9999)))
    assert everything == {"once": 9999.0, "twice": 1.0, "same": 0.0, "thrice": 5.0, "untimed": 9999.0}
    delivered = dict(rows(features.order_gaps(shop, delivered_only=True, single_order_default=0)))
    assert delivered == {"once": 0.0, "twice": 1.0, "same": 0.0, "thrice": 10.0, "untimed": 0.0}
    updated = dict(rows(features.update_customers(shop), "customer_unique_id", gap))
    assert updated == delivered


def test_mean_gap_is_exact_days(make_shop, order, people):
    shop = make_shop(
        customers=people({"c1": "p", "c2": "q"}),
        orders=[
            order("a", "c1", "2020-01-01 00:00:00"),
            order("b", "c1", "2020-01-02 12:00:00"),
            order("c", "c1", "2020-01-04 00:00:00"),
            order("d", "c2", "2020-01-04 00:00:00"),
        ],
    )
    assert rows(customers.mean_days_between_orders(shop, YEAR)) == [(1.5,)]


@pytest.mark.parametrize("unknown_early,expected", [(False, ["fresh"]), (True, [])])
def test_first_time_categories_and_an_unknown_person(make_shop, order, item, people, unknown_early, expected):
    early = [order("u", "c4", "2019-01-01 00:00:00")] if unknown_early else []
    shop = make_shop(
        customers=people({"c1": "old", "c2": "new", "c3": "late", "c4": None}),
        products=[
            {"product_id": n, "product_category_name": n, "product_category_name_english": e}
            for n, e in (("stale", "stale"), ("fresh", "fresh"), ("nameless", None))
        ],
        orders=[
            order("a", "c1", "2019-01-01 00:00:00"),
            order("b", "c1", "2020-01-01 00:00:00"),
            order("c0", "c2", "2018-01-01 00:00:00", status="canceled"),
            order("c", "c2", "2020-01-01 00:00:00"),
            order("d", "c3", "2021-01-01 00:00:00"),
            *early,
        ],
        order_items=[
            item("b", product="stale"),
            item("c", product="fresh"),
            item("c", product="nameless"),
            item("d", product="fresh"),
        ],
    )
    found = customers.top_categories_of(shop, YEAR, "first_time")
    assert [r[0] for r in rows(found)] == expected
    repeat = customers.top_categories_of(shop, YEAR, "repeat")
    assert rows(repeat) == [("stale", 1, 11.0)]


def test_customer_type_is_checked(make_shop):
    with pytest.raises(ValueError):
        customers.top_categories_of(make_shop(), YEAR, "loyal")


def test_both_churn_rules(make_shop, order, people):
    shop = make_shop(
        customers=people({"c1": "gone", "c2": "stays", "c3": "never", "c4": "sent"}),
        orders=[
            order("a", "c1", "2020-01-01 00:00:00"),
            order("b", "c2", "2020-01-01 00:00:00"),
            order("c", "c2", "2020-12-01 00:00:00"),
            order("d", "c4", "2020-12-01 00:00:00", status="shipped"),
        ],
    )
    now = datetime(2020, 12, 31)
    assert rows(customers.churn_any_old_order(shop, now)) == [(200.0 / 3,)]
    assert rows(customers.churn_last_delivered(shop, now)) == [(25.0,)]


def test_two_reviews_double_the_items_of_an_order(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c": "p"}),
        products=[
            {"product_id": "p", "product_category_name_english": "toys"},
            {"product_id": "n", "product_category_name_english": None},
        ],
        orders=[order("a", "c", "2020-01-01 00:00:00"), order("b", "c", "2020-01-01 00:00:00")],
        order_items=[item("a", 1), item("a", 2), item("b", 1), item("b", 2, product="n")],
        reviews=[
            {"review_id": "1", "order_id": "a", "review_score": 5},
            {"review_id": "2", "order_id": "a", "review_score": 2},
            {"review_id": "3", "order_id": "a", "review_score": None},
        ],
    )
    # Two items times three reviews, plus one item without review; scores 5, 2, 5, 2.
    assert rows(products.category_performance(shop, YEAR)) == [("toys", 77.0, 2, 3.5)]


def test_items_without_category_are_a_group_of_their_own(make_shop, item):
    shop = make_shop(
        products=[
            {"product_id": "p", "product_category_name_english": "toys"},
            {"product_id": "n", "product_category_name_english": None},
        ],
        order_items=[item("a"), item("b", product="n"), item("c", product="n"), item("d", product="absent")],
    )
    got = [tuple(r) for r in products.top_selling_categories(shop).collect()]
    assert got == [(None, 2), ("toys", 1)]


def test_line_numbers_weigh_the_order_value(make_shop, item):
    shop = make_shop(order_items=[item("a", 1, 10, 1), item("a", 2, 20, 2), item("a", 3, 0, 0.5)])
    assert rows(features.order_values(shop)) == [("a", 11 + 44 + 1.5)]


def test_delivery_days_truncate_toward_zero_and_skip_gaps(make_shop, order, people):
    def sent(order_id, arrived, expected):
        return order(
            order_id,
            "c",
            "2020-01-10 12:00:00",
            order_approved_at="2020-01-10 18:00:00",
            order_delivered_carrier_date="2020-01-11 12:00:00" if arrived else None,
            order_delivered_customer_date=arrived,
            order_estimated_delivery_date=expected,
        )

    shop = make_shop(
        customers=people({"c": "p"}),
        orders=[
            sent("a", "2020-01-12 11:00:00", "2020-01-20 12:00:00"),
            sent("b", "2020-01-08 13:00:00", "2020-01-20 12:00:00"),
            sent("c", None, "2020-01-20 12:00:00"),
        ],
    )
    # 1 day 23 h counts 1, minus 1 day 23 h counts -1.
    assert rows(logistics.delivery_against_estimate(shop)) == [(0.0, 10.0)]
    ((state, actual, promised, n, variance),) = rows(logistics.shipping_performance(shop, YEAR))
    assert (state, n, promised) == ("SP", 2, 10.0) and actual == pytest.approx(0.0) and variance == -10.0
    ((_, paid, handed, carried),) = rows(logistics.delivery_breakdown(shop, YEAR))
    assert (paid, handed) == (0.25, 0.75) and carried == pytest.approx(-1.0)
    assert len(rows(logistics.delivery_stages(shop, YEAR))) == 3
    assert rows(logistics.shipping_punctuality(shop, YEAR), "variance_color") == [("Early/OnTime",)]


def test_state_filter_and_ties_at_the_cut(make_shop, order):
    stages = {
        "order_approved_at": "2020-01-01 00:00:00",
        "order_delivered_carrier_date": "2020-01-01 00:00:00",
        "order_delivered_customer_date": "2020-01-01 00:00:00",
    }
    states = ["D", "C", "B", "A"]
    shop = make_shop(
        customers=[{"customer_id": s, "customer_unique_id": s, "customer_state": s} for s in states],
        orders=[order(s, s, "2020-01-01 00:00:00", **stages) for s in states],
    )
    top = rows(logistics.delivery_breakdown(shop, YEAR, top_n=2), "customer_state")
    assert top == [("A",), ("B",)]
    assert rows(logistics.delivery_breakdown(shop, YEAR, region="D"), "customer_state") == [("D",)]


def test_heatmap_has_all_days(make_shop, order):
    shop = make_shop(
        orders=[
            order("a", "c", "2020-01-05 09:00:00"),  # a Sunday
            order("b", "c", "2020-01-11 09:30:00", status="shipped"),  # a Saturday
            order("c", "c", "2020-01-11 23:30:00"),
        ]
    )
    grid = orders.order_heatmap(shop, YEAR)
    assert grid.columns == ["hour_of_day", "Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
    assert rows(grid) == [(9, 1, 0, 0, 0, 0, 0, 1), (23, 0, 0, 0, 0, 0, 0, 1)]
    assert rows(orders.peak_slot(shop, YEAR)) == [("Sun", 9, 1)]


def test_histogram_of_equal_values_and_of_a_range(make_shop, order, item, people):
    def shop(*prices):
        ids = {f"c{i}": f"p{i}" for i in range(len(prices))}
        return make_shop(
            customers=people(ids),
            orders=[order(c, c, "2020-01-01 00:00:00") for c in ids],
            order_items=[item(c, price=p, freight=0) for c, p in zip(ids, prices)],
        )

    assert rows(customers.spend_histogram(shop(5, 5), YEAR)) == [(1, 2)]
    assert rows(customers.spend_histogram(shop(0, 1, 50, 100), YEAR)) == [(1, 2), (26, 1), (50, 1)]


def test_old_values_of_unmatched_rows_stay(make_shop, order, item, people):
    from pyspark.sql import functions as F

    shop = make_shop(
        customers=people({"c1": "buyer", "c2": "looker"}),
        orders=[order("a", "c1", "2020-01-01 00:00:00"), order("b", "c1", "2020-01-02 00:00:00", "canceled")],
        order_items=[item("a")],
    )
    shop = shop.but(customers=shop.customers.withColumn("clv", F.lit(7.0)))
    got = rows(
        features.update_customers(shop), "customer_id", "clv", "total_orders", "estimated_return_rate"
    )
    assert got[0] == ("c1", 11.0, 1, 50.0)
    assert got[1] == ("c2", 7.0, None, None)
