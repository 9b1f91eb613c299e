"""The eight shop tables as one value that every operator takes."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from mercadia.sources.schemas import TABLES

Source = DataFrame | Callable[[], DataFrame]
FACTS = ("order_fact", "sales_fact")


class Shop:
    """Frames of the shop tables, opened on first use; unneeded ones may be left out.

    ``order_fact`` and ``sales_fact`` are the stored, month-partitioned facts of
    ``mercadia.plans.facts``. When they are given, operators scan them instead of
    joining the base tables again.
    """

    customers: DataFrame | None
    sellers: DataFrame | None
    products: DataFrame | None
    orders: DataFrame | None
    order_items: DataFrame | None
    payments: DataFrame | None
    reviews: DataFrame | None
    geolocation: DataFrame | None
    order_fact: DataFrame | None
    sales_fact: DataFrame | None

    def __init__(self, **sources: Source):
        unknown = set(sources) - {*TABLES, *FACTS}
        if unknown:
            raise ValueError(f"not shop tables: {sorted(unknown)}")
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in TABLES and name not in FACTS:
            raise AttributeError(name)
        source = self._sources.get(name)
        frame = source() if callable(source) else source
        setattr(self, name, frame)
        return frame

    def but(self, **sources: Source) -> Shop:
        """The same shop with some tables replaced."""
        return Shop(**{**self._sources, **sources})

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Shop:
        """Cleaned zone written by ``warehouse.save_tables``."""

        def table(name: str) -> DataFrame:
            return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")

        return cls(**{name: partial(table, name) for name in TABLES})

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are there, facts left out."""
        return {name: getattr(self, name) for name in TABLES if name in self._sources}

    def register_views(self, prefix: str = "") -> None:
        """Temporary views for parameterised SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
