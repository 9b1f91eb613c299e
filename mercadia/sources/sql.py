"""Parameterised SQL over the shop tables."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from mercadia.sources.shop import Shop


def run_query(spark: SparkSession, shop: Shop, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL that names tables as ``{orders}`` and parameters as ``:start_date``.

    Both are bound, never pasted into the text. Times are bound as text, which Spark
    reads as the type of the column they are compared with, free of time zones.
    """
    bound = {
        name: value.isoformat(" ") if isinstance(value, datetime) else value
        for name, value in (params or {}).items()
    }
    return spark.sql(text, args=bound, **shop.tables())
