"""Column expressions at their limits."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercadia.functions.columns import amount, cents, period_start, seconds_between, whole_days


def test_cents_are_exact_up_to_ten_digits(spark):
    rng = random.Random(5)
    pairs = [(Decimal(rng.randrange(10**10)) / 100, Decimal(rng.randrange(10**10)) / 100) for _ in range(5000)]
    pairs += [(Decimal("99999999.99"), Decimal("99999999.99")), (Decimal("-0.01"), Decimal("0.00"))]
    df = spark.createDataFrame(pairs, "a decimal(10,2), b decimal(10,2)")
    for row in df.select("a", "b", cents(F.col("a"), F.col("b")).alias("c")).collect():
        assert row["c"] == int((row["a"] + row["b"]) * 100)
    total = df.agg(amount(F.sum(cents(F.col("a")))).alias("t")).first()["t"]
    assert total == float(sum(a for a, _ in pairs))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Over a change to summer time in New York.
        df = spark.sql(
            "SELECT TIMESTAMP_NTZ '2021-03-13 12:00:00' AS a, TIMESTAMP_NTZ '2021-03-15 11:00:00.5' AS b"
        )
        row = df.select(
            seconds_between("a", "b").alias("s"),
            whole_days("a", "b").alias("d"),
            period_start("week", "b").cast("string").alias("w"),
            period_start("quarter", "b").cast("string").alias("q"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["s"] == Decimal("169200.5") and row["d"] == 1
    assert (row["w"], row["q"]) == ("2021-03-15 00:00:00", "2021-01-01 00:00:00")
