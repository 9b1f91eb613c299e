"""Reading the raw CSV zone, the cleaned zone, and the model data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.sources.schemas import DATASETS, RAW_FILES, RAW_SCHEMAS, TABLES

# Review texts hold line breaks, which makes a file unsplittable; the others stay splittable.
MULTI_LINE = {"reviews"}


def read_raw(spark: SparkSession, path: str, table: str, ingest_order: bool = False) -> DataFrame:
    """One raw table, from its file or from a folder of that name with many part files.

    ``ingest_order`` adds the position of a row: file, offset of the split in the file,
    and the running number within the task that reads the split.
    """
    frame = (
        spark.read.schema(RAW_SCHEMAS[table])
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", table in MULTI_LINE)
        .csv(f"{path}/{RAW_FILES[table]}")
    )
    if not ingest_order:
        return frame
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )
    return frame.withColumn("ingest_order", place)


def read_cleaned_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A cleaned table kept as CSV, with the types of the data model."""
    return (
        spark.read.schema(TABLES[table])
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", table in MULTI_LINE)
        .csv(f"{path}/{table}_cleaned.csv")
    )


def read_dataset(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A model data set as CSV. Order by ``ds`` where a model needs order."""
    return spark.read.schema(DATASETS[kind]).option("header", True).csv(path)
