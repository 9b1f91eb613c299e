"""Customer segmentation with k-means and the scores of a clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.functions.columns import ratio, with_row
from mercadia.plans.facts import PERSON

# The six features, the default number of segments, the seed.
FEATURES = (
    "clv",
    "total_orders",
    "avg_order_value",
    "avg_days_between_orders",
    "avg_shipping_cost",
    "estimated_return_rate",
)
SEGMENTS, SEED = 3, 42


def standardise(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Centre each feature and divide by its population deviation; constants become 0.

    Rows without a value in some feature drop out.
    """
    rows = df.na.drop(subset=list(features))
    stats = rows.agg(
        *(F.avg(f).alias(f"mean_{f}") for f in features),
        *(F.stddev_pop(f).alias(f"std_{f}") for f in features),
    )

    def scaled(f: str) -> Column:
        centred = F.col(f) - F.col(f"_stats.mean_{f}")
        return F.coalesce(F.try_divide(centred, F.col(f"_stats.std_{f}")), F.lit(0.0)).alias(f"z_{f}")

    described = with_row(rows, stats, "_stats")
    return described.select("*", *(scaled(f) for f in features)).drop("_stats")


def fit_segments(df: DataFrame, k: int = SEGMENTS, seed: int = SEED):
    """Fitted assemble → scale → k-means pipeline over the rows with all features."""
    features = [F.col(f).cast("double").alias(f) for f in FEATURES]
    training = df.select(*features).na.drop()
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(training)


def label_segments(model, df: DataFrame) -> DataFrame:
    """Segment of every row with all features; segments are numbered by rising mean clv."""
    clustered = model.transform(df.na.drop(subset=list(FEATURES)))
    centres = model.stages[-1].clusterCenters()
    by_value = sorted(range(len(centres)), key=lambda c: tuple(centres[c]))
    rank = {cluster: position for position, cluster in enumerate(by_value)}
    number = F.array(*(F.lit(rank[cluster]) for cluster in range(len(centres))))[F.col("cluster")]
    return clustered.withColumn("segment", number).drop("raw", "cluster")


def segment_customers(df: DataFrame, k: int = SEGMENTS, keep_unclustered: bool = True) -> DataFrame:
    """The rows with a ``segment`` column; rows that lack a feature get NULL or are left out."""
    labelled = label_segments(fit_segments(df, k), df).drop("scaled")
    if not keep_unclustered:
        return labelled
    lacking = reduce(lambda a, b: a | b, (F.col(f).isNull() | F.isnan(f) for f in FEATURES))
    return labelled.unionByName(df.filter(lacking).withColumn("segment", F.lit(None).cast("int")))


def calinski_harabasz(
    df: DataFrame, features: tuple[str, ...], segment: str = "segment"
) -> DataFrame:
    """Between-segment over within-segment scatter, each per degree of freedom.

    One pass: size, means and population variances per segment hold all that is needed.
    """
    sizes = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(f).alias(f"c_{f}") for f in features),
        *(F.var_pop(f).alias(f"v_{f}") for f in features),
    )
    grand = sizes.agg(*((F.sum(F.col("n") * F.col(f"c_{f}")) / F.sum("n")).alias(f) for f in features))
    away = sum((F.pow(F.col(f"c_{f}") - F.col(f"_all.{f}"), F.lit(2.0)) for f in features), F.lit(0.0))
    inside = sum((F.col(f"v_{f}") for f in features), F.lit(0.0))
    scatter = with_row(sizes, grand, "_all").select(
        "n", (F.col("n") * away).alias("between"), (F.col("n") * inside).alias("within")
    )
    k, n = F.count(F.lit(1)), F.sum("n")
    score = ratio(F.sum("between"), k - 1) / ratio(F.sum("within"), n - k)
    return scatter.agg(score.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: tuple[str, ...], segment: str = "segment") -> DataFrame:
    """Mean over segments of the worst (spread + spread) / centre distance."""
    centres = df.groupBy(segment).agg(*(F.avg(f).alias(f"c_{f}") for f in features))

    def distance(left: str, right: str) -> Column:
        squares = (
            F.pow(F.col(f"{left}{f}") - F.col(f"{right}{f}"), F.lit(2.0)) for f in features
        )
        return F.sqrt(sum(squares, F.lit(0.0)))

    spread = (
        df.join(centres, segment)
        .groupBy(segment)
        .agg(
            F.avg(distance("", "c_")).alias("spread"),
            *(F.max(f"c_{f}").alias(f"c_{f}") for f in features),
        )
    )
    # As many rows as segments: every other segment becomes an element of each row.
    others = spread.agg(F.collect_list(F.struct(*spread.columns)))
    pairs = spread.select("*", F.explode(others.scalar()).alias("other")).filter(
        F.col(segment) != F.col(f"other.{segment}")
    )
    similarity = (F.col("spread") + F.col("other.spread")) / distance("c_", "other.c_")
    worst = pairs.groupBy(segment).agg(F.max(similarity).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def _square(left: Column, right: Column) -> Column:
    """Squared distance of two arrays."""
    squares = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _total(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + of(x))


def clustering_scores(points: DataFrame, features: tuple[str, ...], segment: str = "segment") -> DataFrame:
    """Silhouette (squared distances), Calinski-Harabasz and Davies-Bouldin in two passes, one row.

    Numbers, sums and sums of squares per segment give every row's mean squared distance to each
    segment, and the scatter between and within segments. A second pass adds up the rows'
    silhouettes and distances to their centres. Segments are compared with each other as the
    elements of one short list.
    """
    rows = points.select(F.col(segment).alias("_s"), F.array(*(F.col(f).cast("double") for f in features)).alias("_x"))
    at = range(len(features))
    sums = rows.groupBy("_s").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.sum(F.col("_x")[i]) for i in at)).alias("sum"),
        F.sum(_dot(F.col("_x"), F.col("_x"))).alias("squares"),
    )
    known = sums.agg(F.collect_list(F.struct(F.col("_s").alias("s"), "n", "sum", "squares"))).scalar()
    x, own = F.col("_x"), F.col("_own")

    def mean_square(s: Column) -> Column:
        total = s["n"] * _dot(x, x) - F.lit(2.0) * _dot(x, s["sum"]) + s["squares"]
        return ratio(total, s["n"])

    others = F.transform(F.filter("_all", lambda s: s["s"] != F.col("_s")), mean_square)
    within = ratio(mean_square(own) * own["n"], own["n"] - 1)
    width = F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))
    centre = F.transform(own["sum"], lambda v: v / own["n"])
    second = (
        rows.withColumn("_all", known)
        .withColumn("_own", F.filter("_all", lambda s: s["s"] == F.col("_s"))[0])
        .withColumns({"_a": within, "_b": F.array_min(others), "_spread": F.sqrt(_square(x, centre))})
        .withColumn("_width", F.when(F.col("_b").isNotNull(), F.coalesce(width, F.lit(0.0))))
        .groupBy("_s")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_width").alias("width"),
            F.avg("_spread").alias("spread"),
            F.first("_own").alias("_own"),
        )
    )
    one = second.agg(
        F.collect_list(F.struct("n", "width", "spread", F.col("_own.sum").alias("sum"), F.col("_own.squares").alias("squares"))).alias("all")
    )
    centred = one.select(
        F.transform(
            "all",
            lambda s: F.struct(
                s["n"].alias("n"),
                s["width"].alias("width"),
                s["spread"].alias("spread"),
                F.transform(s["sum"], lambda v: v / s["n"]).alias("c"),
                (s["squares"] - ratio(_dot(s["sum"], s["sum"]), s["n"])).alias("within"),
            ),
        ).alias("all")
    )
    n, k = _total(F.col("all"), lambda s: s["n"].cast("double")), F.size("all").cast("double")
    grand = F.array(*(_total(F.col("all"), lambda s, i=i: s["n"] * s["c"][i]) / n for i in at))
    between = _total(F.col("all"), lambda s: s["n"] * _square(s["c"], F.col("grand")))
    inside = _total(F.col("all"), lambda s: s["within"])

    def worst(i: Column) -> Column:
        s = F.element_at("all", i)
        pairs = F.transform(
            F.filter(F.sequence(F.lit(1), F.size("all")), lambda j: j != i),
            lambda j: F.try_divide(
                s["spread"] + F.element_at("all", j)["spread"], F.sqrt(_square(s["c"], F.element_at("all", j)["c"]))
            ),
        )
        return F.array_max(pairs)

    likeness = F.transform(F.sequence(F.lit(1), F.size("all")), worst)
    return centred.filter(F.size("all") > 0).withColumn("grand", grand).select(
        (_total(F.col("all"), lambda s: s["width"]) / n).alias("silhouette"),
        (ratio(between, k - 1) / ratio(inside, n - k)).alias("calinski_harabasz"),
        (_total(likeness, lambda v: v) / k).alias("davies_bouldin"),
    )


def segment_scores(model, df: DataFrame) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of a fitted segmentation, one row."""
    labelled = label_segments(model, df)
    names = tuple(f"x{i}" for i in range(len(FEATURES)))
    values = vector_to_array("scaled")
    points = labelled.select("segment", *(values[i].alias(n) for i, n in enumerate(names)))
    return clustering_scores(points, names)


def _stratified(points: DataFrame, most: int, seed: int) -> list[Row]:
    """About `most` rows (s, n, x) in proportion to the segments, at least one of each; drawn by a hash."""
    sizes = {row["s"]: row["count"] for row in points.groupBy("s").count().collect()}
    whole = sum(sizes.values())
    quota = F.create_map(*(F.lit(v) for s, n in sizes.items() for v in (s, -(-n * most // whole)))) if sizes else None
    if quota is None:
        return []
    drawn = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), "x"))
    ranked = points.withColumn("rank", F.row_number().over(drawn)).filter(F.col("rank") <= most)
    size = F.create_map(*(F.lit(v) for item in sizes.items() for v in item))
    return ranked.filter(F.col("rank") <= quota[F.col("s")]).select("s", size[F.col("s")].alias("n"), "x").collect()


def silhouette_on_sample(
    df: DataFrame,
    features: tuple[str, ...],
    segment: str = "segment",
    sample_size: int = 2000,
    seed: int = SEED,
) -> DataFrame:
    """Silhouette with plain Euclidean distances of a stratified sample against all rows, one row.

    The sample, at most ``sample_size`` rows and one more for each segment, goes to all tasks. A
    task adds up the distances of its rows per sample row and segment, so a pair is never a row
    and the work is rows times sample size. Where the sample holds every row the score is
    exact; else it is the mean over segments, each weighted by its size.
    """
    values = F.array(*(F.col(f).cast("double") for f in features)).alias("x")
    points = df.select(F.col(segment).alias("s"), values).filter(F.col("s").isNotNull())
    sample = _stratified(points, sample_size, seed)
    if not sample:
        return df.sparkSession.createDataFrame([], "silhouette double, sample_rows long, segments long")
    drawn = np.array([row["x"] for row in sample])
    order = sorted({row["s"] for row in sample})
    place = {s: k for k, s in enumerate(order)}
    sizes = np.array([next(row["n"] for row in sample if row["s"] == s) for s in order], float)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), len(drawn)))
        for batch in batches:
            labels = np.array([place[s] for s in batch.column(0).to_pylist()], int)
            rows = np.array(batch.column(1).to_pylist(), float).reshape(len(labels), -1)
            for begin in range(0, len(rows), 256):
                part = rows[begin : begin + 256]
                square = np.zeros((len(drawn), len(part)))
                for d in range(drawn.shape[1]):
                    square += (drawn[:, d, None] - part[None, :, d]) ** 2
                distance, own = np.sqrt(square), labels[begin : begin + 256]
                for k in np.unique(own):
                    total[k] += distance[:, own == k].sum(axis=1)
        k, i = np.indices(total.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.record_batch(columns, ["i", "k", "total"])

    sums = points.mapInArrow(added, "i int, k int, total double").groupBy("i", "k").agg(F.sum("total").alias("total"))
    own = F.array(*(F.lit(place[row["s"]]) for row in sample))[F.col("i")]
    size = F.array(*map(F.lit, sizes.tolist()))
    apart = sums.withColumns({"own": own, "n": size[F.col("k")]})
    is_own = F.col("k") == F.col("own")
    widths = apart.groupBy("i", "own").agg(
        F.max(F.when(is_own, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"),
    )
    # A row alone in its segment has a width of 0.
    width = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    means = widths.filter("b is not null").groupBy("own").agg(F.avg(width).alias("mean"), F.count("*").alias("rows"))
    weight = size[F.col("own")]
    return means.agg(
        ratio(F.sum(F.col("mean") * weight), F.sum(weight)).alias("silhouette"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("sample_rows"),
        F.count("*").alias("segments"),
    )


def model_centres(model) -> DataFrame:
    """Centres of a fitted segmentation: each feature in scaled (``z_``) and in raw units.

    Segments are numbered by rising mean clv, as the labels are.
    """
    scaler, centres = model.stages[1], model.stages[2].clusterCenters()
    mean, deviation = scaler.mean.toArray(), scaler.std.toArray()
    rows = [
        (number, *map(float, centre), *map(float, centre * deviation + mean))
        for number, centre in enumerate(sorted(centres, key=tuple))
    ]
    names = [*(f"z_{f} double" for f in FEATURES), *(f"{f} double" for f in FEATURES)]
    return SparkSession.active().createDataFrame(rows, ", ".join(["segment int", *names]))


def nearest_members(
    df: DataFrame, key: str, features: tuple[str, ...] = FEATURES, segment: str = "segment", n: int = 5
) -> DataFrame:
    """The ``n`` members of each segment that are nearest to its mean, in deviations of each feature.

    Ties go by key. Only ``n`` rows of a segment leave each task.
    """
    rows = standardise(df, features)
    centres = rows.groupBy(F.col(segment).alias("_segment")).agg(*(F.avg(f"z_{f}").alias(f"_c_{f}") for f in features))
    away = sum((F.pow(F.col(f"z_{f}") - F.col(f"_c_{f}"), F.lit(2.0)) for f in features), F.lit(0.0))
    met = rows.join(centres, F.col(segment) == F.col("_segment")).withColumn("distance", F.round(F.sqrt(away), 6))
    nearest = Window.partitionBy(segment).orderBy("distance", key)
    ranked = met.withColumn("member_rank", F.row_number().over(nearest)).filter(F.col("member_rank") <= n)
    return ranked.select(segment, "member_rank", key, "distance", *features)


def segment_centres(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Size and mean features of each segment."""
    return df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), *(F.avg(f).alias(f) for f in features)
    )


def segment_summary(df: DataFrame) -> DataFrame:
    """Persons, mean value, mean order value and mean frequency per segment."""
    people = df.groupBy("segment", PERSON).agg(
        *(F.sum(c).alias(c) for c in ("clv", "avg_order_value", "total_orders")),
        *(F.count(c).alias(f"n_{c}") for c in ("clv", "avg_order_value", "total_orders")),
    )

    def mean(name: str) -> Column:
        return ratio(F.sum(name), F.sum(f"n_{name}"))

    return people.groupBy(F.col("segment").alias("segment_label")).agg(
        F.count(PERSON).alias("number_of_customers"),
        mean("clv").alias("avg_clv"),
        mean("avg_order_value").alias("avg_aov_segment"),
        mean("total_orders").alias("avg_order_frequency_segment"),
    )
