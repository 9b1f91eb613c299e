"""Batch jobs from the raw zone to feature tables, data sets and model results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.operators import cleaning, datasets, features, forecast, segments
from mercadia.plans.checkpoints import cut_lineage
from mercadia.sources import raw_csv, versions, warehouse
from mercadia.sources.shop import Shop


def clean_raw(spark: SparkSession, raw_path: str) -> Shop:
    """Cleaned tables over the raw CSV zone; still lazy."""

    def raw(table: str) -> DataFrame:
        return raw_csv.read_raw(spark, raw_path, table)

    def ordered(table: str) -> DataFrame:
        return raw_csv.read_raw(spark, raw_path, table, ingest_order=True)

    customers = cleaning.clean_customers(ordered("customers"))
    sellers = cleaning.passed_through(raw("sellers"))
    # Raw payments have no number of their own; one follows from what identifies them.
    payments = cleaning.passed_through(raw("payments")).withColumn(
        "payment_id", F.xxhash64("order_id", "payment_sequential")
    )
    cleaned = {
        "customers": customers,
        "sellers": sellers,
        "products": cleaning.clean_products(raw("products"), raw("category_translation")),
        "orders": cleaning.clean_orders(raw("orders")),
        "order_items": cleaning.clean_order_items(raw("order_items")),
        "payments": payments,
        "reviews": cleaning.clean_reviews(ordered("reviews")),
        "geolocation": cleaning.fix_missing_zip_codes(
            cleaning.clean_geolocation(ordered("geolocation")), customers, sellers
        ),
    }
    return Shop(**{name: warehouse.typed(df, name) for name, df in cleaned.items()})


def run_cleaning(spark: SparkSession, raw_path: str, cleaned_path: str) -> Shop:
    """Write the cleaned zone and read it back."""
    warehouse.save_tables(clean_raw(spark, raw_path), cleaned_path)
    return Shop.from_parquet(spark, cleaned_path)


def run_features(shop: Shop, path: str, computed_at: datetime, version: str | None = None) -> str:
    """Write the updated tables as a new version under ``path``, and the day's feature store.

    The version is named after the time of computation unless a name is given. Its four tables
    become current together, when all are written; ``versions.read_current`` reads them.
    Returns the version's folder.
    """

    def write(folder: str) -> None:
        warehouse.save(features.update_customers(shop), f"{folder}/customers")
        warehouse.save(features.purchase_documents(shop), f"{folder}/purchase_documents")
        warehouse.save(features.update_products(shop), f"{folder}/products")
        warehouse.save(features.update_orders(shop), f"{folder}/orders")
        warehouse.save_features(
            features.precomputed_features(shop, computed_at), f"{path}/precomputed_features"
        )

    spark = next(iter(shop.tables().values())).sparkSession
    return versions.publish(spark, path, version or computed_at.strftime("%Y%m%dT%H%M%S"), write)


def run_datasets(shop: Shop, path: str) -> None:
    """Write the model inputs: series without outliers, segmentation and recommendation sets."""
    for frequency in datasets.SERIES:
        series = datasets.remove_outliers_log(datasets.sales_series(shop, frequency), "y")
        warehouse.save_csv(series, f"{path}/forecasting_dataset_{frequency}")
    warehouse.save_csv(datasets.segmentation_dataset(shop), f"{path}/segmentation_dataset")
    warehouse.save_csv(datasets.recommendation_dataset(shop), f"{path}/recommendation_dataset")


def run_segmentation(dataset: DataFrame, path: str, k: int = segments.SEGMENTS) -> None:
    """Write labelled customers and the scores of the clustering.

    k-means reads its input many times, so the features are materialised once.
    """
    rows = cut_lineage(dataset)
    model = segments.fit_segments(rows, k)
    labelled = segments.label_segments(model, rows).drop("scaled")
    warehouse.save_csv(labelled, f"{path}/segmentation_results")
    warehouse.save_csv(segments.segment_scores(model, rows), f"{path}/segmentation_metrics")


def forecast_all(series: dict[str, DataFrame]) -> DataFrame:
    """Forecasts of several named frequencies in one frame."""
    frames = [
        forecast.forecast(df).withColumn("frequency", F.lit(name)) for name, df in series.items()
    ]
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame)
    return combined


def run_forecasts(series: dict[str, DataFrame], path: str) -> None:
    """Write forecasts and the metrics of every frequency, series and model."""
    forecasts = cut_lineage(forecast_all(series))
    warehouse.save(forecasts, f"{path}/forecasts")
    metrics = forecast.forecast_metrics(forecasts, ("frequency", "series_id"))
    warehouse.save_csv(metrics, f"{path}/combined_forecast_metrics")


def run_level_forecasts(shop: Shop, path: str, frequencies: tuple[str, ...] = ("weekly", "daily")) -> None:
    """Forecast the shop, each state, each category and each pair of them, all in one grouped job."""
    series = cut_lineage(datasets.sales_series_levels(shop, frequencies))
    trimmed = datasets.remove_outliers_log(series, "y", by=["series_id"])
    forecasts = cut_lineage(forecast.forecast(trimmed))
    warehouse.save(forecasts, f"{path}/forecasts")
    warehouse.save_csv(forecast.forecast_metrics(forecasts), f"{path}/forecast_metrics")
