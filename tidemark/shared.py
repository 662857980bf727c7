"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; only a session without that setting (a local test) gets a folder of its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "2m") -> None:
    """Limit the bytes of a batch that goes to Python, unless the session has a limit of its own.

    Spark's default bounds rows, so a batch of long texts takes tens of megabytes several times over in each task.
    The setting holds when a query is run, so it stays in the session.
    """
    if spark.conf.get(BATCH_BYTES, "64m") in ("64m", "67108864b", str(64 << 20)):
        spark.conf.set(BATCH_BYTES, size)


_written: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this session's operators have written so far; their results can't be read any more. Returns how many."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    count = 0
    while _written:
        path = hadoop.Path(_written.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count
