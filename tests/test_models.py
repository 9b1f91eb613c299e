"""Data sets, segmentation and forecasting."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercadia.operators import datasets, forecast, segments
from mercadia.plans import pipelines


# --- outliers ---------------------------------------------------------------------------


def values(df, column="y"):
    return sorted(r[column] for r in df.select(column).collect())


def test_outliers_go_nan_goes_and_bounds_stay(spark):
    y = [10.0, 11.0, 12.0, 13.0, 14.0, 1000.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in y], "y double")
    assert values(datasets.remove_outliers_log(df, "y")) == [10.0, 11.0, 12.0, 13.0, 14.0]


@pytest.mark.parametrize("bad", [0.0, -1.0])
def test_non_positive_values_are_an_error(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "y double")
    with pytest.raises(Exception, match="above 0"):
        datasets.remove_outliers_log(df, "y").collect()


def test_outliers_per_group(spark):
    rows = [("a", 10.0 + i) for i in range(5)] + [("a", 1e6)] + [("b", 1e6 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, y double")
    kept = datasets.remove_outliers_log(df, "y", by=["g"])
    assert kept.count() == 10 and kept.filter("g = 'a' and y > 100").count() == 0


# --- segments ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clouds(spark):
    """Three far clouds and a row without a value; one feature is constant."""
    rng = np.random.default_rng(1)
    rows = []
    for i, centre in enumerate((10.0, 500.0, 2000.0)):
        for j in range(40):
            a, b, c = rng.normal(centre, 3.0, 3)
            rows.append((f"p{i}-{j}", float(a), int(1 + i), float(b), float(c), 5.0, float(i)))
    rows.append(("nobody", None, None, None, None, None, 0.0))
    names = ", ".join(f"{f} {'int' if f == 'total_orders' else 'double'}" for f in segments.FEATURES)
    return spark.createDataFrame(rows, f"customer_unique_id string, {names}")


def test_clouds_become_segments_by_rising_value(clouds):
    labelled = segments.segment_customers(clouds)
    assert labelled.count() == 121
    found = {(r["customer_unique_id"].split("-")[0], r["segment"]) for r in labelled.collect()}
    assert found == {("p0", 0), ("p1", 1), ("p2", 2), ("nobody", None)}
    assert segments.segment_customers(clouds, keep_unclustered=False).count() == 120


def brute_scores(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Squared-distance silhouette, Calinski-Harabasz and Davies-Bouldin, point by point."""
    kinds, n = sorted(set(labels)), len(points)
    square = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    widths = []
    for i in range(n):
        own = [j for j in range(n) if labels[j] == labels[i] and j != i]
        a = square[i, own].mean()
        b = min(square[i, labels == k].mean() for k in kinds if k != labels[i])
        widths.append((b - a) / max(a, b))
    centres = {k: points[labels == k].mean(0) for k in kinds}
    within = sum(((points[labels == k] - centres[k]) ** 2).sum() for k in kinds)
    between = sum((labels == k).sum() * ((centres[k] - points.mean(0)) ** 2).sum() for k in kinds)
    spread = {k: np.sqrt(((points[labels == k] - centres[k]) ** 2).sum(1)).mean() for k in kinds}
    worst = [
        max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in kinds if j != i)
        for i in kinds
    ]
    score = (between / (len(kinds) - 1)) / (within / (n - len(kinds)))
    return float(np.mean(widths)), score, float(np.mean(worst))


def test_scores_by_brute_force(clouds):
    model = segments.fit_segments(clouds)
    labelled = segments.label_segments(model, clouds).select("scaled", "segment").toPandas()
    points = np.array([v.toArray() for v in labelled["scaled"]])
    expected = brute_scores(points, labelled["segment"].to_numpy())
    row = segments.segment_scores(model, clouds).first()
    got = (row["silhouette"], row["calinski_harabasz"], row["davies_bouldin"])
    assert got == pytest.approx(expected, rel=1e-6)


def test_constant_features_standardise_to_zero(clouds):
    scaled = segments.standardise(clouds)
    assert scaled.count() == 120
    row = scaled.agg(
        F.max("z_avg_shipping_cost").alias("constant"), F.avg("z_clv").alias("mean"), F.stddev_pop("z_clv").alias("std")
    ).first()
    assert row["constant"] == 0.0
    assert row["mean"] == pytest.approx(0.0, abs=1e-9) and row["std"] == pytest.approx(1.0)


def test_scores_ignore_the_names_of_segments(clouds):
    rows = segments.standardise(clouds).withColumn("segment", F.col("total_orders"))
    renamed = rows.withColumn("segment", (5 - F.col("segment")) * 7)
    names = ("z_clv", "z_avg_order_value")
    for score in (segments.calinski_harabasz, segments.davies_bouldin):
        assert score(rows, names).first()[0] == pytest.approx(score(renamed, names).first()[0])


def test_scores_of_many_segments(spark):
    rows = spark.range(4_000).select((F.col("id") % 2_000).alias("segment"), (F.col("id") * 1.0).alias("a"))
    # Each segment has two points 2000 apart, and its neighbours' centres are 1 away.
    assert segments.davies_bouldin(rows, ("a",)).first()[0] == pytest.approx(2_000.0)


def test_rows_with_nan_are_kept_without_segment(spark, clouds):
    odd = clouds.na.drop().limit(1).withColumn("clv", F.lit(float("nan")))
    found = segments.segment_customers(clouds.unionByName(odd), 3)
    assert found.count() == clouds.count() + 1
    complete = clouds.na.drop(subset=list(segments.FEATURES)).count()
    assert found.filter("segment is not null").count() == complete


def test_arima_goes_over_gaps():
    y = np.arange(20.0) * 3
    y[7] = np.nan
    assert forecast.arima_forecast(y, 3) == pytest.approx([60, 63, 66], abs=0.5)
    assert np.isnan(forecast.arima_forecast(np.array([1.0, np.nan, 2.0]), 2)).all()


def test_a_failing_fit_leaves_the_others(spark, monkeypatch):
    def fails(*_):
        raise np.linalg.LinAlgError("singular")

    assert np.isnan(forecast._or_nan(fails, 2)).all()


def test_segmentation_job(spark, clouds, tmp_path):
    pipelines.run_segmentation(clouds, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/segmentation_results").count() == 120
    assert spark.read.option("header", True).csv(f"{tmp_path}/segmentation_metrics").count() == 1


def test_summary_counts_persons_once(spark):
    rows = [(0, "p", 10.0, 1.0, 2), (0, "p", 10.0, 1.0, 2), (0, "q", 40.0, 4.0, 8), (1, None, None, 1.0, 1)]
    df = spark.createDataFrame(
        rows, "segment int, customer_unique_id string, clv double, avg_order_value double, total_orders int"
    )
    found = {r["segment_label"]: tuple(r)[1:] for r in segments.segment_summary(df).collect()}
    assert found[0] == (2, 20.0, 2.0, 4.0)
    assert found[1] == (0, None, 1.0, 1.0)


# --- forecasts --------------------------------------------------------------------------


def test_split_takes_the_last_rows(spark):
    rows = [("a", date(2020, 1, 1) + timedelta(days=i), float(i)) for i in range(10)] + [("b", date(2020, 1, 1), 1.0)]
    marked = forecast.train_test_split(spark.createDataFrame(rows, "series_id string, ds date, y double"))
    assert sorted(r["y"] for r in marked.filter("is_test and series_id = 'a'").collect()) == [4, 5, 6, 7, 8, 9]
    assert marked.filter("series_id = 'b' and is_test").count() == 1


def simulated_arima(n: int, phi: float, theta: float) -> np.ndarray:
    noise = np.random.default_rng(3).normal(0, 1, n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + noise[t] + theta * noise[t - 1]
    return 100 + np.cumsum(w)


def test_arima_follows_a_persistent_trend():
    y = simulated_arima(600, 0.8, 0.3)
    steps = np.diff(y)
    first, second = np.diff(np.r_[y[-1], forecast.arima_forecast(y, 2)])
    # From the second step on the move decays by phi.
    assert second / first == pytest.approx(0.8, abs=0.1)
    assert np.isfinite(steps).all()


def test_arima_beats_the_last_value_on_average():
    y = simulated_arima(800, 0.8, 0.3)
    ours, naive = 0.0, 0.0
    for end in range(700, 790, 10):
        truth = y[end : end + 6]
        ours += np.abs(truth - forecast.arima_forecast(y[:end], 6)).sum()
        naive += np.abs(truth - y[end - 1]).sum()
    assert ours < naive


def test_series_without_two_steps_have_no_arima():
    assert np.isnan(forecast.arima_forecast(np.array([1.0, 2.0]), 3)).all()
    assert np.isnan(forecast.arima_forecast(np.array([1.0, np.nan, 2.0, np.nan, 4.0, 5.0]), 3)).all()


def test_seasonal_model_recovers_trend_and_year():
    ds = pd.Series(pd.date_range("2015-01-04", periods=260, freq="W"))
    t = (ds - ds.iloc[0]).dt.days.to_numpy()
    y = 100 + 0.05 * t + 20 * np.sin(2 * np.pi * t / 365.25)
    found = forecast.seasonal_forecast(ds[:254], y[:254], ds[254:])
    assert np.abs(found - y[254:]).max() < 3


def test_seasonal_model_steps_weekly_and_takes_the_nearest_date():
    ds = pd.Series(pd.date_range("2020-01-01", periods=100, freq="D"))
    y = np.arange(100.0) + 1
    found = forecast.seasonal_forecast(ds[:94], y[:94], ds[94:])
    # The next two weekly points are all that six daily test dates can be near to.
    assert len(found) == 6 and len(set(found.round(9))) <= 2
    assert np.isnan(forecast.seasonal_forecast(ds[:1], y[:1], ds[1:3])).all()


def test_forecasts_of_many_series(spark):
    rows = [
        (name, date(2015, 1, 4) + timedelta(weeks=i), 100.0 + i * slope)
        for name, slope in (("up", 1.0), ("flat", 0.0))
        for i in range(120)
    ] + [("short", date(2015, 1, 4), 5.0)]
    series = spark.createDataFrame(rows, "series_id string, ds date, y double")
    found = forecast.forecast(series)
    assert found.count() == 13
    up = found.filter("series_id = 'up'").toPandas()
    assert np.allclose(up["arima"], up["y"], atol=0.5)
    assert np.allclose(up["ensemble"], (up["arima"] + up["seasonal"]) / 2)
    short = found.filter("series_id = 'short'").first()
    assert math.isnan(short["arima"]) and math.isnan(short["ensemble"])
    metrics = forecast.forecast_metrics(found)
    assert metrics.count() == 9
    row = metrics.filter("series_id = 'up' and model = 'arima'").first()
    assert row["mape_pct"] < 1 and row["mae"] < 0.5
    short_row = metrics.filter("series_id = 'short' and model = 'arima'").first()
    assert math.isnan(short_row["rmse"])


def test_metrics_of_zero_and_constant_truth(spark):
    df = spark.createDataFrame(
        [("zero", 0.0, 1.0), ("zero", 2.0, 1.0), ("const", 3.0, 3.0), ("const", 3.0, 3.0), ("off", 3.0, 4.0)],
        "series_id string, y double, f double",
    )
    found = {r["series_id"]: r for r in forecast.compute_metrics(df, "y", "f", ("series_id",)).collect()}
    assert found["zero"]["mape_pct"] == pytest.approx((1 / forecast.EPSILON + 0.5) / 2 * 100)
    assert found["zero"]["r2"] == pytest.approx(0.0)
    assert found["const"]["r2"] == 1.0 and found["off"]["r2"] == 0.0


def test_forecast_job(spark, tmp_path):
    rows = [("all", date(2015, 1, 4) + timedelta(weeks=i), 100.0 + i) for i in range(60)]
    series = spark.createDataFrame(rows, "series_id string, ds date, y double")
    pipelines.run_forecasts({"weekly": series, "daily": series}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/forecasts").count() == 12
    assert spark.read.option("header", True).csv(f"{tmp_path}/combined_forecast_metrics").count() == 6
