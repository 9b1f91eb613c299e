"""Versions of derived tables: written aside, then put on a list that readers go by.

A version is a folder of tables under the store's path. It counts from the moment it is put on the
store's list, one small append that comes last; until then, and while it is read, the version before
stays as it is. A run that failed can be run again under the same name, and one that has ended is not
written twice. Old versions go on request only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "published_versions"
LIST = "version string, place long"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, oldest first; one for each run of a job."""
    listed = f"{path}/{PUBLISHED}"
    if not _exists(spark, listed):
        return []
    return [row["version"] for row in spark.read.schema(LIST).parquet(listed).orderBy("place").collect()]


def publish(spark: SparkSession, path: str, version: str, write: Callable[[str], None]) -> str:
    """Write a version with ``write(folder)`` and put it on the list; returns its folder."""
    before, folder = versions(spark, path), f"{path}/version={version}"
    if version not in before:
        write(folder)
        row = spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.lit(len(before)).cast("long").alias("place"))
        row.write.mode("append").parquet(f"{path}/{PUBLISHED}")
    return folder


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest published version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version published under {path}")
    return f"{path}/version={found[-1]}"


def read_current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the newest version; the frame goes on reading that version if another is published."""
    return spark.read.parquet(f"{current(spark, path)}/{table}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the folders of all but the newest ``keep`` versions, and those of failed runs."""
    kept = {f"version={v}" for v in versions(spark, path)[-keep:]} if keep else set()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    gone = sorted(n for n in names if n.startswith("version=") and n not in kept)
    for name in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return [name.partition("=")[2] for name in gone]
