"""Tables written between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="curatrix-llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a short lineage that outlives executors.

    The files go with ``forget``, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    target = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(target)
    out.stored_at = target
    return out


def forget(*frames: DataFrame, sweep: bool = True) -> None:
    """Delete tables of ``stored`` whose readers have all been written; with ``sweep``, Spark's cleaner also drops the shuffle files of finished jobs."""
    for df in frames:
        if getattr(df, "stored_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            df.stored_at = None
    if sweep and frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
