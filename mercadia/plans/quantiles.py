"""Exact quantiles of any number of values, without a task that holds the values of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.plans.checkpoints import cut_lineage

#: Ranges that a span of values is counted in, and the most values that are gathered to end with.
BINS, GATHERED = 256, 4096


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, quantiles): interpolated between neighbours, an array in the order of ``shares``.

    NULL and NaN are left out; a group without any other value has no row. For each wanted rank
    the span that holds it is cut into ``BINS`` ranges whose values are counted where they are; the
    span of the one range that holds the rank is taken up again, until it is one value or holds at
    most ``GATHERED`` values. A round reads the rows once and shuffles counts only.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v"))
    spans = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    places = F.array(*(F.lit(float(q)) for q in shares))
    ranks = F.array_distinct(
        F.flatten(F.transform(places, lambda q: F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1)))))
    )
    # A rank's span: its ends, the values in it, and the values below it.
    state = spans.filter("_n > 0").select(
        *by, "_n", F.explode(ranks).alias("_rank"), "_low", "_high", F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_below")
    )
    state = cut_lineage(state)
    while state.filter((F.col("_low") < F.col("_high")) & (F.col("_in") > GATHERED)).take(1):
        state = cut_lineage(_narrowed(known, state, by))
    ended = state.filter("_low = _high").select(*by, "_n", "_rank", F.col("_low").alias("_value"))
    spread = _matched(known, state.filter("_low < _high"), by)
    listed = spread.groupBy(*by, "_n", "_rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_list"))
    ended = ended.unionByName(listed.select(*by, "_n", "_rank", F.element_at("_list", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_value")))
    # A handful of ranks for each group.
    found = ended.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def between(q: Column) -> Column:
        place = q * (F.col("_n") - 1)
        low, high = F.element_at("_at", F.floor(place)), F.element_at("_at", F.ceil(place))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return found.select(*by, F.transform(places, between).alias("quantiles"))


def _matched(known: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Values within the spans of their group's ranks."""
    spans = state.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in state.columns if c not in by))
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    if not by:
        # As many rows as ranks, so each value meets them as one short list.
        whole = spans.agg(F.collect_list(F.struct(*spans.columns)).alias("_spans"))
        met = known.withColumn("_span", F.explode(whole.scalar())).select("_v", "_span.*")
        return met.filter(inside)
    return known.join(spans, same & inside).drop(*(f"_{c}" for c in by))


def _octaves(v: Column) -> Column:
    """A finite number that rises with v by one for each doubling; 0 for 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.least(F.log2(F.abs(v)), F.lit(1100.0)) + 1100.0))


def _share() -> Column:
    """How far a value is into its span: by octaves, or by itself where the ends are nearly within one.

    So a few rounds do for values of any spread. The ends are 0 and 1, which makes every round narrow the span.
    """
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    wide = _octaves(high) - _octaves(low)
    return F.when(wide > 1, (_octaves(v) - _octaves(low)) / wide).otherwise((v - low) / (high - low))


def _narrowed(known: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Each open rank's span, cut down to the range that holds the rank."""
    open_ = (F.col("_low") < F.col("_high")) & (F.col("_in") > GATHERED)
    met = _matched(known, state.filter(open_), by)
    counted = met.groupBy(*by, "_n", "_rank", "_below", F.least(F.floor(_share() * BINS), F.lit(BINS - 1)).alias("_bin")).agg(
        F.count("*").alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    # One row for each range: at most BINS in a window.
    through = Window.partitionBy(*by, "_rank").orderBy("_bin")
    ends = counted.withColumn("_to", F.col("_below") + F.sum("_in").over(through))
    chosen = ends.filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_in")))
    fresh = chosen.withColumn("_below", F.col("_to") - F.col("_in")).select(state.columns)
    return state.filter(~open_).unionByName(fresh)
