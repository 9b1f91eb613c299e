"""Writing tables, facts, feature tables and model results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.params import MONTH, PURCHASE
from mercadia.operators.quality import require_sound
from mercadia.plans.facts import build_order_fact, build_sales_fact
from mercadia.sources.schemas import LOAD_ORDER, TABLES
from mercadia.sources.shop import Shop

# Column that names the load of a row, and the table of loads that ended.
LOAD, LOADS = "load_id", "loads"

# Join key by which a table can be bucketed.
BUCKET_KEYS = {
    "orders": "order_id",
    "order_items": "order_id",
    "payments": "order_id",
    "reviews": "order_id",
    "customers": "customer_id",
}


def save(df: DataFrame, path: str, *, by: str | None = None, mode: str = "overwrite") -> None:
    """Write Parquet. ``by`` partitions the table; the rebalance hint lets AQE give a
    large partition several tasks and fold small ones, whatever the distribution."""
    if by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header, as many part files as there are tasks."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_tables(shop: Shop, path: str) -> None:
    """The cleaned zone, one Parquet folder per table; orders by month of purchase."""
    for name, df in shop.tables().items():
        if name == "orders":
            df = df.withColumn(MONTH, F.trunc(F.col(PURCHASE).cast("date"), "month"))
        save(df, f"{path}/{name}", by=MONTH if name == "orders" else None)


def typed(df: DataFrame, table: str) -> DataFrame:
    """Columns, order and types of the data model; an absent column is NULL."""
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        )
    )


def create_tables(spark: SparkSession, database: str, buckets: int | None = None) -> None:
    """Declare the eight empty tables in the session catalog, and the list of loads.

    Every table is partitioned by the load that brought a row. With ``buckets`` the order tables
    are bucketed by order and the customers by id, so adding items up per order and joining them
    needs no shuffle. AQE cannot split a bucket: leave them out where one order may hold a large
    share of the items.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        bucketing = f"CLUSTERED BY ({BUCKET_KEYS[name]}) INTO {buckets} BUCKETS" if _bucketed(name, buckets) else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, {LOAD} string) USING parquet "
            f"PARTITIONED BY ({LOAD}) {bucketing}"
        )
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{LOADS} ({LOAD} string, loaded_at timestamp_ntz) USING parquet")


def _bucketed(table: str, buckets: int | None) -> bool:
    return buckets is not None and table in BUCKET_KEYS


def loads(spark: SparkSession, database: str) -> set[str]:
    """Names of the loads that ended; one for each batch ever loaded."""
    return {row[LOAD] for row in spark.table(f"{database}.{LOADS}").select(LOAD).collect()}


def load_tables(
    shop: Shop, database: str, check: bool = True, buckets: int | None = None, load_id: str | None = None
) -> str:
    """Append a batch of tables, parents before children; returns the name of the load.

    ``check`` refuses a batch that breaks a key, reference, range or width rule, alone or together
    with what is stored: keys must be new, parents may be stored already, and a batch may have any of
    the tables. ``buckets`` is the number the tables were created with; each bucket is then
    written by one task.

    Rows go to partitions of their own and count from the moment the load is put on the list of
    loads, which comes last. A load that failed half-way is invisible; run again under its
    ``load_id`` it replaces what it had written, and once it has ended a further run does nothing.
    Batches are loaded one at a time.
    """
    frames = shop.tables()
    spark = next(iter(frames.values())).sparkSession
    load_id = load_id or uuid.uuid4().hex
    if not re.fullmatch(r"[\w-]+", load_id):
        raise ValueError(f"a load's name is made of letters, digits, - and _, not {load_id!r}")
    if load_id in loads(spark, database):
        return load_id
    if check:
        require_sound(shop, read_database(spark, database))
    for name in LOAD_ORDER:
        if name in frames:
            rows = typed(frames[name], name)
            if _bucketed(name, buckets):
                rows = rows.repartition(buckets, BUCKET_KEYS[name])
            into = f"INSERT OVERWRITE {database}.{name} PARTITION ({LOAD} = '{load_id}')"
            spark.sql(f"{into} SELECT * FROM {{rows}}", rows=rows)
    ended = spark.range(1, numPartitions=1).select(F.lit(load_id), F.localtimestamp())
    ended.write.mode("append").insertInto(f"{database}.{LOADS}")
    return load_id


def drop_failed_loads(spark: SparkSession, database: str) -> None:
    """Delete the rows of loads that did not end."""
    ended = loads(spark, database)
    for name in TABLES:
        for row in spark.sql(f"SHOW PARTITIONS {database}.{name}").collect():
            load_id = row["partition"].partition("=")[2]
            if load_id not in ended:
                spark.sql(f"ALTER TABLE {database}.{name} DROP PARTITION ({LOAD} = '{load_id}')")


def read_database(spark: SparkSession, database: str) -> Shop:
    """The rows of all loads that ended."""
    ended = F.col(LOAD).isin(*loads(spark, database))
    return Shop(**{name: spark.table(f"{database}.{name}").filter(ended).drop(LOAD) for name in TABLES})


def save_facts(shop: Shop, path: str) -> None:
    """Build both facts once and store them by purchase month."""
    save(build_order_fact(shop), f"{path}/order_fact", by=MONTH)
    save(build_sales_fact(shop), f"{path}/sales_fact", by=MONTH)


def with_facts(spark: SparkSession, shop: Shop, path: str) -> Shop:
    """The same shop, with operators reading the stored facts."""
    return shop.but(
        order_fact=spark.read.parquet(f"{path}/order_fact"),
        sales_fact=spark.read.parquet(f"{path}/sales_fact"),
    )


def save_features(features: DataFrame, path: str) -> None:
    """Feature store rows, one folder per feature and day of computation.

    A further day adds to the store; the same day's rows are replaced, so a job can run again.
    """
    dated = features.withColumn("computed_date", F.col("computed_at").cast("date"))
    dated.hint("rebalance", "feature_name").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("feature_name", "computed_date").parquet(path)
