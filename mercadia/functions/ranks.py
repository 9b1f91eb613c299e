"""Row numbers over unbounded groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows, dealt to tasks by ranges of (groups, order), with the range's number in `_range`.

    A large group spans several ranges. Store the result before it is read twice: ranges are
    drawn from a sample.
    """
    dealt = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in groups), *order)
    return dealt.withColumn("_range", F.spark_partition_id())


def numbered(stored: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """`ranged` rows with their number from 1 within the group, in a column `name`.

    Rows are numbered within each range and group; the counts of the earlier ranges, one row for
    each range and group, are added. Rows that `order` does not tell apart are numbered in any order.
    Without groups the whole table is numbered, and the driver adds up one count for each range.
    """
    counts = stored.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
    rows = stored.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order)))
    if not groups:
        sizes = {row["_range"]: row["_n"] for row in counts.collect()}
        before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0))
        starts = F.array(*(F.lit(n).cast("long") for n in before))
        return rows.withColumn(name, F.col("_local") + starts[F.col("_range")]).drop("_range", "_local")
    # One row for each range that holds a part of the group: the only part that is in one task.
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_range").alias("_of"),
        *(F.col(c).alias(f"_{c}") for c in groups),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    matched = F.col("_range") == F.col("_of")
    for c in groups:
        matched &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.join(starts, matched).withColumn(name, F.col("_local") + F.col("_before"))
    return joined.drop("_range", "_of", "_local", "_before", *(f"_{c}" for c in groups))
