"""Cutting lineage through tables in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which the session or the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local"):
        # one machine: any of its folders is shared
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later plans start from committed files,
    so a lost executor costs one task and not the lineage. The files go when the driver ends, or by drop()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/kinlink-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinlink_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete the files behind materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kinlink_path", None)
        if path:
            p, fs = _path(df.sparkSession, path)
            fs.delete(p, True)


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more: they would stay until the driver's next collection.
    Python's references go first, and the JVM learns of them with some delay, so it collects twice."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        df.sparkSession.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a file scan, the bytes of the files. Above 2^60 it says that the size is unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """A partition count that follows the data: at least spark.sql.shuffle.partitions, more for a large input."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return max(least, size // bytes_each + 1) if size < 1 << 60 else least
