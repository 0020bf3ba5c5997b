"""Reviews and status updates as they arrive: deduplicated ingest, last-write-wins state, running counts."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Names in a folder of any store; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for n in (s.getPath().getName() for s in store.listStatus(path)) if n.startswith(prefix)) if store.exists(path) else []


def append_new_reviews(reviews: DataFrame, cutoff: dt.datetime, path: str, checkpoint: str) -> None:
    """Each review id once, nothing older than the cutoff, however late it comes.

    Seen ids are keyed state (RocksDB, no expiry), so a batch costs what its own rows cost. Rows that other checkpoints stored in the same table (a
    new or lost checkpoint meets all of them) are taken into that state first: their ids are written beside the checkpoint once, are one more
    source of the stream, and the batches of this call are also checked against them. Every batch owns the folder
    ``load=<checkpoint>/batch=<number>`` of the table and replaces only that, so a batch that is run again writes the same place and nothing
    that was stored before is lost.
    """
    spark, columns = reviews.sparkSession, reviews.columns
    ids = reviews.select("review_id").schema
    load = next(iter(_files(spark, checkpoint, "seed-")), None) or f"seed-{uuid.uuid4().hex}"
    seed, own = f"{checkpoint}/{load}", f"load={load[5:]}"
    if not _files(spark, seed, "_SUCCESS"):
        spark.createDataFrame([], ids).write.mode("append").parquet(seed)
    fresh = None
    if any(name != own for name in _files(spark, path, "load=")):
        known = spark.read.schema(ids).parquet(seed)
        others = spark.read.parquet(path).filter(F.col("load") != own[5:]).select("review_id").distinct()
        folder = shared_folder(spark, "ids")
        others.join(known, "review_id", "left_anti").write.parquet(folder)
        fresh = spark.read.schema(ids).parquet(folder)
        fresh.write.mode("append").parquet(seed)
    seeds = spark.readStream.schema(ids).parquet(seed)
    arriving = reviews.filter(F.col("ts") >= F.lit(cutoff)).withColumn("_known", F.lit(False))
    first = arriving.unionByName(seeds.withColumn("_known", F.lit(True)), allowMissingColumns=True).dropDuplicates(["review_id"])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(~F.col("_known")).select(*columns)
        if fresh is not None:
            rows = rows.join(batch.sparkSession.read.schema(ids).parquet(folder), "review_id", "left_anti").select(*columns)
        rows.write.mode("overwrite").parquet(f"{path}/{own}/batch={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        drain_batches(first, checkpoint, write, "append")
    finally:
        spark.conf.set(STATE_STORE, before)


def drain_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, exactly once per checkpoint, into Parquet files."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_counts(reviews: DataFrame) -> DataFrame:
    """Votes per item so far."""
    return reviews.groupBy("appid").agg(F.count_if("voted_up").alias("positive"), F.count_if(~F.col("voted_up")).alias("negative"), F.count("*").alias("n"))


STATUS_COLUMNS = ("user_id", "appid", "actual_rating", "ignore", "status", "notes", "updated_at")


def latest_status(updates: DataFrame) -> DataFrame:
    """Current row per user and item: last write wins, empty status and notes keep the older value, a delete starts over.

    Columns of ``updates``: the status columns, ``delete`` and ``seq`` (order of arrival).
    """
    keys = ["user_id", "appid"]
    cuts = updates.groupBy(*keys).agg(F.max(F.when(F.col("delete"), F.col("seq"))).alias("_cut"))
    alive = updates.join(cuts, keys).filter(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))

    def last(column: str, only_known: bool = False):
        order = F.when(F.col(column).isNotNull(), F.col("seq")) if only_known else F.col("seq")
        return F.max_by(column, order).alias(column)

    return alive.groupBy(*keys).agg(last("actual_rating"), last("ignore"), last("status", True), last("notes", True), last("updated_at"))


def patch_pool(pool: DataFrame, status: DataFrame) -> DataFrame:
    """A stored pool with the latest status: done items leave, backlog and wishlist flags follow."""
    joined = pool.join(status.select("user_id", "appid", F.col("status").alias("_s")), ["user_id", "appid"], "left")
    kept = joined.filter(F.col("_s").isNull() | ~F.col("_s").isin("played", "rated", "ignored"))
    return kept.withColumns({"is_backlog": F.coalesce(F.col("_s").isin("backlog", "unplayed"), F.lit(False)),
                             "is_wishlist": F.coalesce(F.col("_s") == "wishlist", F.lit(False))}).drop("_s")


def run_status_stream(spark: SparkSession, updates: DataFrame) -> DataFrame:
    """Drain a stream of updates into a change log and return the status table: ``latest_status`` of the log."""
    base = shared_folder(spark, "status")
    drain_to_files(updates, f"{base}/changes", f"{base}/checkpoint")
    return latest_status(spark.read.schema(updates.schema).parquet(f"{base}/changes"))
