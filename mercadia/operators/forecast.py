"""Forecasts of many series at once: split, two models, ensemble, hold-out metrics.

Every series has been aggregated to calendar steps before it gets here, so one series is
small and Spark spreads the series. Frames are (series_id, ds, y).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.columns import ratio

# Rows held out for the test, and the floor of |y| in the percentage error.
TEST_SIZE = 6
EPSILON = float(np.finfo(np.float64).eps)

MODELS = ("arima", "seasonal", "ensemble")
FORECAST_SCHEMA = "series_id string, ds date, y double, arima double, seasonal double"


def train_test_split(series: DataFrame, test_size: int = TEST_SIZE) -> DataFrame:
    """Mark the last ``test_size`` steps of each series as test rows."""
    newest_first = Window.partitionBy("series_id").orderBy(F.desc("ds"))
    return series.select(
        "*", (F.row_number().over(newest_first) <= test_size).alias("is_test")
    )


# --- the two models, one series at a time ---------------------------------------------


def _css_errors(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squared one-step errors of ARMA(1,1) for many parameter pairs, and the last error.

    Over a gap, which NaN marks, the model's own expectation stands in and adds no error.
    """
    error, total = np.zeros_like(phi), np.zeros_like(phi)
    before = np.full_like(phi, w[0] if np.isfinite(w[0]) else 0.0)
    for now in w[1:]:
        expected = phi * before + theta * error
        known = np.isfinite(now)
        error = now - expected if known else np.zeros_like(phi)
        before = np.full_like(phi, now) if known else expected
        total = total + error * error
    return total, error


def arima_forecast(y: np.ndarray, steps: int, least_steps: int = 2) -> np.ndarray:
    """ARIMA(1,1,1) by conditional least squares: a grid over (phi, theta), refined thrice.

    Steps next to a missing value are skipped. With fewer than ``least_steps`` known steps
    nothing can be fitted and the forecast is NaN.
    """
    w = np.diff(y)
    known = np.flatnonzero(np.isfinite(y))
    if np.isfinite(w).sum() < least_steps:
        return np.full(steps, np.nan)
    centre, reach = np.array([0.0, 0.0]), 0.99
    for _ in range(4):
        axes = [np.clip(c + np.linspace(-reach, reach, 23), -0.99, 0.99) for c in centre]
        phi, theta = (axis.ravel() for axis in np.meshgrid(*axes))
        total, error = _css_errors(w, phi, theta)
        best = int(np.argmin(total))
        centre, reach = np.array([phi[best], theta[best]]), reach / 10
    moves, last = [], w[np.isfinite(w)][-1]
    for step in range(steps):
        last = centre[0] * last + (centre[1] * error[best] if step == 0 else 0.0)
        moves.append(last)
    return y[known[-1]] + np.cumsum(moves)


def _seasonal_design(days: np.ndarray, span: float, knots: np.ndarray) -> np.ndarray:
    """Piecewise linear trend on scaled time and ten yearly Fourier pairs."""
    t = days / span
    angle = 2 * np.pi * np.outer(days, np.arange(1, 11)) / 365.25
    hinges = np.maximum(t[:, None] - knots[None, :], 0.0)
    return np.column_stack([np.ones_like(t), t, hinges, np.sin(angle), np.cos(angle)])


def seasonal_forecast(ds: pd.Series, y: np.ndarray, test_ds: pd.Series, step: str = "W") -> np.ndarray:
    """Additive trend plus yearly seasonality by ridge regression.

    Future points advance by ``step`` (weekly, whatever the data is) and each test date
    takes the nearest one. Fewer than two known values give NaN.
    """
    known = np.isfinite(y)
    if known.sum() < 2:
        return np.full(len(test_ds), np.nan)
    start = ds.iloc[0]
    days = (ds - start).dt.days.to_numpy(float)
    span = max(days[-1], 1.0)
    knots = np.linspace(0, 0.8, 26)[1:]
    scale = np.abs(y[known]).max() or 1.0
    design = _seasonal_design(days[known], span, knots)
    # The hinges are held close to 0, the seasonal terms loosely, level and slope freely.
    penalty = np.r_[1e-6, 1e-6, np.full(len(knots), 4.0), np.full(20, 0.01)]
    weights = np.linalg.solve(design.T @ design + np.diag(penalty), design.T @ (y[known] / scale))
    future = pd.date_range(ds.iloc[-1], periods=len(test_ds) + 1, freq=step)
    future = future[future > ds.iloc[-1]][: len(test_ds)]
    ahead = _seasonal_design((future - start).days.to_numpy(float), span, knots) @ weights * scale
    nearest = np.abs(test_ds.to_numpy()[:, None] - future.to_numpy()[None, :]).argmin(axis=1)
    return ahead[nearest]


def _or_nan(model: Callable[..., np.ndarray], steps: int, *args) -> np.ndarray:
    """A model that cannot be fitted to a series has no forecast for it; the others go on."""
    try:
        return model(*args)
    except (ValueError, ArithmeticError, np.linalg.LinAlgError):
        return np.full(steps, np.nan)


def _forecaster(step: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        dates, y = pd.to_datetime(rows["ds"]), rows["y"].to_numpy(float)
        test = rows["is_test"].to_numpy(bool)
        out = rows.loc[test, ["series_id", "ds", "y"]].copy()
        if test.all():
            return out.assign(arima=np.nan, seasonal=np.nan)
        train_y = y[~test]
        out["arima"] = _or_nan(arima_forecast, len(out), train_y, int(test.sum()))
        out["seasonal"] = _or_nan(seasonal_forecast, len(out), dates[~test], train_y, dates[test], step)
        return out

    return one_series


def forecast(series: DataFrame, test_size: int = TEST_SIZE, step: str = "W") -> DataFrame:
    """Actual values of the test rows with the forecasts of both models and their mean."""
    marked = train_test_split(series, test_size).select(
        F.col("series_id").cast("string").alias("series_id"), "ds", "y", "is_test"
    )
    fitted = marked.groupBy("series_id").applyInPandas(_forecaster(step), FORECAST_SCHEMA)
    # A missing pandas value arrives as NULL; a forecast that failed is NaN.
    nan = F.lit(float("nan"))
    return ensemble(
        fitted.withColumns({model: F.coalesce(model, nan) for model in ("arima", "seasonal")})
    )


def ensemble(forecasts: DataFrame) -> DataFrame:
    """Mean of the two model forecasts; NaN stays NaN."""
    return forecasts.withColumn("ensemble", (F.col("arima") + F.col("seasonal")) / 2)


# --- metrics --------------------------------------------------------------------------


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAPE in percent, RMSE, MAE and the sums that R² needs; plain aggregates."""
    error = actual - predicted
    return {
        "mape_pct": F.avg(F.abs(error) / F.greatest(F.abs(actual), F.lit(EPSILON))) * 100,
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "sse": F.sum(error * error),
        "sst": F.var_pop(actual) * F.count(actual),
    }


def compute_metrics(df: DataFrame, actual: str, predicted: str, keys: tuple[str, ...]) -> DataFrame:
    """Hold-out metrics per group. R² of a constant truth is 1 if matched exactly, else 0."""
    sums = df.groupBy(*keys).agg(
        *(c.alias(n) for n, c in metric_columns(F.col(actual), F.col(predicted)).items())
    )
    constant = F.when(F.col("sse") == 0, 1.0).when(~F.isnan("sse"), 0.0).otherwise(F.col("sse"))
    r2 = F.when(F.col("sst") == 0, constant).otherwise(1 - ratio(F.col("sse"), F.col("sst")))
    return sums.select(*keys, "mape_pct", "rmse", "mae", r2.alias("r2"))


def forecast_metrics(forecasts: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Metrics of every model and series."""
    long = forecasts.unpivot([*keys, "ds", "y"], list(MODELS), "model", "forecast")
    return compute_metrics(long, "y", "forecast", (*keys, "model"))


def linear_trend_forecast(marked: DataFrame) -> DataFrame:
    """Test rows with the least-squares line through the training rows, by days: the other yardstick."""
    day = F.datediff("ds", F.lit("1970-01-01")).cast("double")
    days = marked.withColumn("_day", day)
    line = (
        days.filter(~F.col("is_test") & F.col("y").isNotNull() & ~F.isnan("y"))
        .groupBy("series_id")
        .agg(F.regr_slope("y", "_day").alias("_slope"), F.avg("y").alias("_y"), F.avg("_day").alias("_x"))
    )
    value = F.col("_y") + F.coalesce("_slope", F.lit(0.0)) * (F.col("_day") - F.col("_x"))
    tested = days.filter("is_test").join(line, "series_id").withColumn("linear_trend", value)
    return tested.drop("is_test", "_day", "_slope", "_y", "_x")


def last_value_forecast(marked: DataFrame) -> DataFrame:
    """Test rows with the last training value as forecast: the yardstick of the models."""
    last = (
        marked.filter(~F.col("is_test"))
        .groupBy("series_id")
        .agg(F.max_by("y", "ds").alias("last_value"))
    )
    return marked.filter("is_test").drop("is_test").join(last, "series_id")
