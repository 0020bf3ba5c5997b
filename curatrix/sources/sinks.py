"""Writing tables, vectors and constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_items(df: DataFrame, path: str, files: int | None = None) -> None:
    """The item table; clustered by id so that files carry narrow id ranges for pruning."""
    out = df.repartitionByRange(files, "appid") if files else df.repartitionByRange("appid")
    out.sortWithinPartitions("appid").write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_vectors(df: DataFrame, path: str, vector: str = "vec") -> None:
    """Vectors as 4-byte floats, keyed by id."""
    df.select("appid", F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def read_vectors(spark, path: str, vector: str = "vec") -> DataFrame:
    return spark.read.parquet(path).select("appid", F.col(vector).cast("array<double>").alias(vector))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_constants(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Name-value constants with the latest version of each (columns ``name``, ``value``, ``stage``, ``version``)."""
    both = current.unionByName(updates, allowMissingColumns=True)
    return both.groupBy("name").agg(F.max_by(F.struct("value", "stage", "version"), "version").alias("v")).select("name", "v.*")
