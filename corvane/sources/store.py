"""Tables in the shared folder: what a plan writes once and reads often."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir.  Where it is unset, a local session makes a temporary one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most BROADCAST_BYTES; beyond that joins shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that no later plan reads, and let Spark drop the shuffle files of plans that nothing refers to any more.

    Spark's cleaner follows the driver's garbage collection, which a quiet driver puts off while the executors' disks fill.
    """
    for df in tables:
        discard(df)
    gc.collect()
    spark._jvm.System.gc()
