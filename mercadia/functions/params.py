"""Query parameters: reporting period, granularity, reference date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PURCHASE = "order_purchase_timestamp"
MONTH = "purchase_month"

# The five granularities a trend may ask for.
GRANULARITIES = ("day", "week", "month", "quarter", "year")
# Pandas-style frequency codes the dashboard sends; any other means day.
FREQUENCIES = {"ME": "month", "YE": "year"}


def granularity_of(freq: str) -> str:
    """Granularity of a frequency code; unknown codes mean daily."""
    return FREQUENCIES.get(freq, "day")


def ntz(moment: datetime | date) -> Column:
    """Typed literal without a time zone; folds to a constant, so it reaches the scan."""
    return F.lit(moment.isoformat(" ") if isinstance(moment, datetime) else f"{moment} 00:00:00").cast(
        "timestamp_ntz"
    )


@dataclass(frozen=True)
class Period:
    """Closed interval of purchase time."""

    start: datetime
    end: datetime

    @classmethod
    def of_days(cls, first: date, last: date) -> Period:
        """From the first microsecond of ``first`` to the last one of ``last``."""
        return cls(datetime.combine(first, time.min), datetime.combine(last, time.max))

    @classmethod
    def last_year_of(cls, orders: DataFrame) -> Period:
        """The last 365 days up to the newest order. Reads one row back to the driver."""
        newest = orders.agg(F.max(PURCHASE).cast("date").alias("d")).first()["d"]
        newest = newest or date.today()
        return cls.of_days(newest - timedelta(days=365), newest)

    def previous(self) -> Period:
        """The equally long period that ends one second before this one starts."""
        return Period(self.start - (self.end - self.start), self.start - timedelta(seconds=1))

    def __contains__(self, moment: datetime) -> bool:
        return self.start <= moment <= self.end

    def keep(self, df: DataFrame, column: str = PURCHASE) -> DataFrame:
        """Rows inside the period; prunes months when the table is partitioned by month."""
        return self._bounded(df, column, lower=True)

    def keep_until_end(self, df: DataFrame, column: str = PURCHASE) -> DataFrame:
        """Rows up to the end of the period, all earlier history included."""
        return self._bounded(df, column, lower=False)

    def _bounded(self, df: DataFrame, column: str, lower: bool) -> DataFrame:
        kept = df.filter(F.col(column) <= ntz(self.end))
        if lower:
            kept = kept.filter(F.col(column) >= ntz(self.start))
        if MONTH in df.columns:
            kept = kept.filter(F.col(MONTH) <= F.lit(self.end.date().replace(day=1)))
            if lower:
                kept = kept.filter(F.col(MONTH) >= F.lit(self.start.date().replace(day=1)))
        return kept
