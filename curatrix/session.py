"""Session helpers: a tuned local session for tests, and checkpointing that respects the cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("curatrix")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CURATRIX_SHARED") or tempfile.mkdtemp(prefix="curatrix-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session may do without one; a cluster's executors would not see a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="curatrix-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table written by a job, under the cluster's shared folder; it goes when the driver's JVM ends."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session whose workers can't import it."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='curatrix-')}/curatrix", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan through reliable storage.

    The files go with the lineage that uses them, as ``cleanCheckpoints`` is on in sessions made here.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def parallelism(df: DataFrame) -> int:
    """Number of shuffle partitions of the session that owns ``df``."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)))
