"""Ranks, quantiles, series by level and clustering scores, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercadia.functions.params import Period
from mercadia.functions.ranks import numbered, ranged
from mercadia.operators import datasets, features, forecast, kpis, segments
from mercadia.plans import facts, pipelines
from mercadia.plans.checkpoints import cut_lineage
from mercadia.plans.quantiles import exact_quantiles
from mercadia.registry import PERIOD
from mercadia.sources.sample_tables import sample_shop
from tests.conftest import SMALL

# --- ranks ------------------------------------------------------------------------------


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbers_over_ranges(spark, groups):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(50), k) for k in range(3000)]
    order = [F.desc("v"), F.col("k")]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(6)
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = cut_lineage(ranged(df, groups, order))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert dealt.select("_range").distinct().count() > 1
    found = {(r.g, r.v, r.k): r.place for r in numbered(dealt, groups, order, "place").collect()}
    expected, counts = {}, defaultdict(int)
    for g, v, k in sorted(rows, key=lambda r: (-r[1], r[2])):
        key = g if groups else "all"
        counts[key] += 1
        expected[g, v, k] = counts[key]
    assert found == expected


def test_popularity_rank_has_no_window_over_all_products(spark):
    ranked = features.ranked_product_popularity(sample_shop(spark, SMALL))
    assert not re.search(r"Window \[.*\], \[\]", ranked._jdf.queryExecution().executedPlan().toString())
    rows = sorted(ranked.collect(), key=lambda r: r.popularity_rank)
    assert [r.popularity_rank for r in rows] == list(range(1, len(rows) + 1))
    assert rows == sorted(rows, key=lambda r: (-r.total_sales, r.product_id))


def test_the_feature_store_reads_the_items_once(spark):
    shop = sample_shop(spark, SMALL)
    store = features.precomputed_features(shop, datetime(2020, 1, 1))
    plan = store._jdf.queryExecution().executedPlan().toString()
    # Everything behind the stored aggregate is gone from the plan.
    assert "lineitem" not in plan
    assert store.filter("feature_name = 'customer_product_purchases'").count() == features.person_product_counts(shop).count()


# --- quantiles --------------------------------------------------------------------------

DRAWS = {
    "plain": lambda r: r.normalvariate(0, 1),
    "skewed": lambda r: 10.0 ** r.uniform(-12, 12),
    "few values": lambda r: float(r.randrange(3)),
    "one value": lambda r: 7.5,
    "largest": lambda r: r.choice([-8e307, 8e307, 0.0, 5e-324, r.uniform(-8e307, 8e307)]),
}


@pytest.mark.parametrize("name", DRAWS)
def test_quantiles_of_raw_rows(spark, monkeypatch, name):
    """Rounds of counting until the span is small: as if a task could hold 20 values."""
    monkeypatch.setattr("mercadia.plans.quantiles.GATHERED", 20)
    monkeypatch.setattr("mercadia.plans.quantiles.BINS", 16)
    rng = random.Random(3)
    rows = [("hot" if k % 3 else "cold", DRAWS[name](rng)) for k in range(2000)]
    rows += [("hot", None), ("hot", float("nan")), ("empty", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    known = [v for _, v in rows if v is not None and v == v]
    (all_,) = exact_quantiles(df, "v", shares).collect()
    assert all_.quantiles == pytest.approx(list(np.quantile(known, shares)), rel=1e-12, abs=1e-300)
    found = {r.g: r.quantiles for r in exact_quantiles(df, "v", shares, ["g"]).collect()}
    assert set(found) == {"hot", "cold", None}
    for g, quantiles in found.items():
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert quantiles == pytest.approx(list(np.quantile(own, shares)), rel=1e-12, abs=1e-300)


def test_quantiles_with_infinities(spark, monkeypatch):
    monkeypatch.setattr("mercadia.plans.quantiles.GATHERED", 3)
    inf = float("inf")
    values = [-inf] * 5 + [1.0, 2.0, 3.0, 4.0, 1.7e308, -1.7e308] + [inf] * 10
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [k / 20 for k in range(21)]
    assert exact_quantiles(df, "v", shares).first().quantiles == sorted(values)


def test_no_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, "v", (0.5,)).collect() == []
    assert exact_quantiles(empty, "v", (0.5,), ["g"]).collect() == []


@pytest.mark.parametrize("by", [[], ["g"]])
def test_outliers_of_raw_rows_are_those_of_series(spark, monkeypatch, by):
    monkeypatch.setattr("mercadia.plans.quantiles.GATHERED", 10)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 10.0 ** rng.gauss(0, 1)) for _ in range(500)] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, y double")
    left = datasets.remove_outliers_log(df, "y", by=by, unbounded=True)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, datasets.remove_outliers_log(df, "y", by=by).collect()))


# --- series by level --------------------------------------------------------------------


@pytest.fixture
def small(make_shop, order, item, people):
    """Two states, two categories and none; an unknown customer and an unknown product."""
    known = people({"c1": "alice", "c2": "bob"})
    known[1]["customer_state"] = "RJ"
    return make_shop(
        customers=known,
        orders=[
            order("o1", "c1", "2018-01-01 10:00:00"), order("o2", "c2", "2018-01-03"), order("o3", "gone", "2018-01-03"),
            order("o4", "c1", "2018-01-09"), order("o5", "c1", "2018-01-09", "canceled"),
        ],
        order_items=[
            item("o1", 1, 10, 1, "p1"), item("o1", 2, 20, 2, "p2"), item("o2", 1, 5, 0, "p1"), item("o3", 1, 7, 0, "lost"),
            item("o4", 3, 1, 1, "p3"), item("o5", 1, 100, 0, "p1"),
        ],
        products=[
            {"product_id": "p1", "product_category_name_english": "toys"},
            {"product_id": "p2", "product_category_name_english": "books"},
            {"product_id": "p3"},
        ],
    )


def test_levels_of_series(small):
    for shop in (small, small.but(sales_fact=facts.build_sales_fact(small))):
        found = {(r.series_id, str(r.ds)): r.y for r in datasets.sales_series_levels(shop, ["weekly"]).collect()}
        first, second = "2018-01-01", "2018-01-08"
        assert found == {
            ("weekly", first): 67.0, ("weekly", second): 6.0,
            ("weekly/state=SP", first): 55.0, ("weekly/state=SP", second): 6.0,
            ("weekly/state=RJ", first): 5.0, ("weekly/state=?", first): 7.0,
            ("weekly/category=toys", first): 16.0, ("weekly/category=books", first): 44.0,
            ("weekly/category=?", first): 7.0, ("weekly/category=?", second): 6.0,
            ("weekly/state=SP/category=toys", first): 11.0, ("weekly/state=SP/category=books", first): 44.0,
            ("weekly/state=SP/category=?", second): 6.0, ("weekly/state=RJ/category=toys", first): 5.0,
            ("weekly/state=?/category=?", first): 7.0,
        }
    totals = datasets.level_totals(datasets.sales_series_levels(small)).collect()
    assert len(totals) == 12 and {r.total for r in totals} == {73.0}


def test_the_shop_level_is_the_whole_series(spark):
    shop = sample_shop(spark, SMALL)
    levels = datasets.sales_series_levels(shop, ["weekly"]).filter("level = 'shop'").select("ds", "y")
    whole = datasets.sales_series(shop, "weekly").filter("y is not null")
    assert sorted(map(tuple, levels.collect())) == sorted(map(tuple, whole.collect()))


def test_levels_need_one_pass_over_the_items(spark):
    plan = datasets.sales_series_levels(sample_shop(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    # The sample's orders derive their dates from the items, which is the other scan.
    assert len(re.findall(r"FileScan parquet .*l_extendedprice", plan)) == 1


def test_all_levels_are_forecast_in_one_job(spark, small, tmp_path):
    days = [datetime(2018, 1, 1).toordinal() + k for k in range(40)]
    series = spark.createDataFrame(
        [(s, date.fromordinal(d), 10.0 + i + d % 3) for i, s in enumerate(("daily", "daily/state=SP")) for d in days],
        "series_id string, ds date, y double",
    )
    assert forecast.forecast(series).groupBy("series_id").count().collect() == forecast.forecast(series).groupBy("series_id").count().collect()
    pipelines.run_level_forecasts(sample_shop(spark, SMALL), str(tmp_path), ("weekly",))
    written = spark.read.parquet(f"{tmp_path}/forecasts")
    names = {r.series_id for r in written.select("series_id").distinct().collect()}
    assert "weekly" in names and any("/state=" in n and "/category=" in n for n in names)
    plan = forecast.forecast(series)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


# --- both periods -----------------------------------------------------------------------


def test_both_periods_in_one_pass(spark, make_shop, order, item, people):
    plan = kpis.kpis_against_previous(sample_shop(spark, SMALL), PERIOD)._jdf.queryExecution().executedPlan().toString()
    alone = kpis.main_kpis(sample_shop(spark, SMALL), PERIOD)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == alone.count("FileScan")
    shop = make_shop(
        customers=people({"c1": "a", "c2": "b"}),
        orders=[
            order("o1", "c1", "2018-01-01"), order("o2", "c2", "2017-12-31 23:59:59.500"), order("o3", "c1", "2017-12-31 23:59:59"),
        ],
        order_items=[item("o1"), item("o2"), item("o3")],
    )
    row = kpis.kpis_against_previous(shop, Period.of_days(date(2018, 1, 1), date(2018, 1, 2))).first()
    # The half second before the period belongs to neither.
    assert (row.total_orders, row.previous_total_orders, row.delta_total_orders) == (1, 1, 0)
    row = kpis.kpis_against_previous(shop, Period.of_days(date(2019, 1, 1), date(2019, 1, 2))).first()
    assert (row.total_orders, row.total_revenue, row.previous_active_customers, row.delta_new_customers) == (0, None, 0, 0)


def test_new_customers_of_all_history(make_shop, order, item, people):
    shop = make_shop(
        customers=people({"c1": "old", "c2": "old", "c3": "new", "c4": "later"}),
        orders=[
            order("o1", "c1", "2017-05-01"), order("o2", "c2", "2018-01-01"), order("o3", "c3", "2018-01-02"),
            order("o4", "c4", "2018-01-01", "canceled"), order("o5", "c4", "2018-02-01"),
        ],
        order_items=[item(f"o{k}") for k in range(1, 6)],
    )
    row = kpis.kpis_first_ever(shop, Period.of_days(date(2018, 1, 1), date(2018, 1, 31))).first()
    assert (row.total_orders, row.total_revenue, row.active_customers, row.new_customers) == (2, 22.0, 2, 1)
    row = kpis.kpis_first_ever(shop, Period.of_days(date(2016, 1, 1), date(2016, 1, 31))).first()
    assert (row.total_orders, row.total_revenue, row.active_customers, row.new_customers) == (0, None, 0, 0)


# --- clustering scores ------------------------------------------------------------------


def brute(points: np.ndarray, labels: np.ndarray, power: int) -> float:
    kinds, widths = sorted(set(labels)), []
    apart = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)) ** power
    for i, own in enumerate(labels):
        inside = [j for j in range(len(labels)) if labels[j] == own and j != i]
        if not inside:
            widths.append(0.0)
            continue
        a = apart[i, inside].mean()
        b = min(apart[i, labels == k].mean() for k in kinds if k != own)
        widths.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(widths))


@pytest.fixture(scope="module")
def blurred(spark):
    """Overlapping clouds, repeated rows, and one row alone in its segment."""
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 2.0, (60, 3)) for c in (0.0, 2.0, 5.0)] + [np.full((10, 3), 2.0), np.full((1, 3), 40.0)])
    labels = np.array([0] * 60 + [1] * 60 + [2] * 60 + [1] * 10 + [9])
    rows = [(int(k), *map(float, x), i) for i, (k, x) in enumerate(zip(labels, points))]
    return points, labels, spark.createDataFrame(rows, "segment int, a double, b double, c double, key long").repartition(5)


def test_scores_by_sufficient_statistics(blurred):
    points, labels, df = blurred
    names = ("a", "b", "c")
    row = segments.clustering_scores(df, names).first()
    assert row.silhouette == pytest.approx(brute(points, labels, 2), rel=1e-9)
    assert row.calinski_harabasz == pytest.approx(segments.calinski_harabasz(df, names).first()[0], rel=1e-9)
    assert row.davies_bouldin == pytest.approx(segments.davies_bouldin(df, names).first()[0], rel=1e-9)
    plan = segments.clustering_scores(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2


def test_scores_of_one_segment_and_of_none(spark, blurred):
    df = blurred[2]
    row = segments.clustering_scores(df.filter("segment = 0"), ("a", "b")).first()
    assert (row.calinski_harabasz, row.davies_bouldin) == (None, None)
    assert segments.clustering_scores(df.limit(0), ("a", "b")).collect() == []


def test_silhouette_of_a_sample_that_holds_all_rows_is_exact(blurred):
    points, labels, df = blurred
    row = segments.silhouette_on_sample(df, ("a", "b", "c"), sample_size=1000).first()
    assert (row.sample_rows, row.segments) == (len(labels), 4)
    assert row.silhouette == pytest.approx(brute(points, labels, 1), rel=1e-12)


def test_silhouette_of_a_sample_is_near(blurred):
    points, labels, df = blurred
    row = segments.silhouette_on_sample(df, ("a", "b", "c"), sample_size=80).first()
    assert 80 <= row.sample_rows <= 84 and row.segments == 4
    assert row.silhouette == pytest.approx(brute(points, labels, 1), abs=0.08)
    assert segments.silhouette_on_sample(df.limit(0), ("a",)).collect() == []


def test_centres_in_both_units(spark):
    rng = np.random.default_rng(3)
    values = [[float(v) for v in rng.normal(m, 2.0, 6) * (1, 1, 10, 1, 1, 1)] for m in (5.0, 500.0) for _ in range(50)]
    df = spark.createDataFrame([(f"p{i}", *v) for i, v in enumerate(values)], "customer_unique_id string, " + ", ".join(f"{f} double" for f in segments.FEATURES))
    model = segments.fit_segments(df, k=2)
    centres = segments.model_centres(model).orderBy("segment").collect()
    means = segments.segment_centres(segments.label_segments(model, df)).orderBy("segment").collect()
    scaled = segments.standardise(df)
    half = scaled.filter("clv < 100").agg(*(F.avg(f"z_{f}").alias(f) for f in segments.FEATURES)).first()
    for f in segments.FEATURES:
        for centre, mean in zip(centres, means):
            assert centre[f] == pytest.approx(mean[f], rel=1e-9)
        # The model scales by the sample deviation.
        assert centres[0][f"z_{f}"] == pytest.approx(half[f] * (99 / 100) ** 0.5, rel=1e-9)


def test_nearest_members(blurred):
    points, labels, df = blurred
    names = ("a", "b", "c")
    scaled = (points - points.mean(0)) / points.std(0)
    expected = set()
    for k in sorted(set(labels)):
        own = np.flatnonzero(labels == k)
        distance = np.round(np.sqrt(((scaled[own] - scaled[own].mean(0)) ** 2).sum(1)), 6)
        best = sorted(zip(distance, own))[:4]
        expected |= {(int(k), rank + 1, int(i)) for rank, (_, i) in enumerate(best)}
    found = segments.nearest_members(df, "key", names, n=4)
    assert {(r.segment, r.member_rank, r.key) for r in found.collect()} == expected
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
