"""Helpers that the operators share: stored intermediate tables, bounded broadcasts, settled values."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Texts can be very long, so a batch holds few of them.
ARROW_ROWS = 256


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch, unless the session already does."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a local session may lack one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Tables:
    """Intermediate results stored in the shared folder: they cut lineage and survive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}"

    def stored(self, df: DataFrame) -> DataFrame:
        """Write a frame and return the frame that reads it back."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete stored frames that no later step reads."""
        for frame in frames:
            for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
                if folder.replace("file://", "file:").startswith(self.folder.replace("file://", "file:")):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a frame for broadcasting if it has few rows; beyond that Spark shuffles as it sees fit."""
    return F.broadcast(df) if len(df.limit(most_rows + 1).select(F.lit(1)).take(most_rows + 1)) <= most_rows else df


def learning_row(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text is no multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def settled(value: Column) -> Column:
    """A value that is computed where it stands.

    The optimiser neither copies it into the expressions that read it, where a lambda would compute
    it for every element, nor moves filters on it below.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
