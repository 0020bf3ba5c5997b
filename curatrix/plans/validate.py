"""Completeness checks of a build: every artefact has every item, the right steps and the required names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(items: DataFrame, artefacts: dict[str, DataFrame], grid: DataFrame | None = None, steps: int = 21,
             constants: DataFrame | None = None, required: Sequence[str] = ()) -> DataFrame:
    """One row per check: (check, expected, actual, ok). Keys are compared both ways, never by position."""
    ids = items.select("appid")
    spark = items.sparkSession

    def row(name: str, expected, actual) -> DataFrame:
        return spark.range(1).select(F.lit(name).alias("check"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual"))

    def count(df: DataFrame):
        return df.agg(F.count("*").alias("x")).scalar()

    total = count(ids)
    out = row("items.distinct", total, count(ids.distinct()))
    for name, df in artefacts.items():
        keys = df.select("appid")
        out = out.unionByName(row(f"{name}.rows", total, count(keys)))
        out = out.unionByName(row(f"{name}.missing", F.lit(0), count(ids.join(keys, "appid", "left_anti"))))
        out = out.unionByName(row(f"{name}.unknown", F.lit(0), count(keys.join(ids, "appid", "left_anti"))))
    if grid is not None:
        out = out.unionByName(row("grid.steps", F.lit(steps), count(grid.select("step").distinct())))
        out = out.unionByName(row("grid.rows", total * F.lit(steps), count(grid)))
    if constants is not None:
        wanted = spark.createDataFrame([(r,) for r in required], "name string")
        out = out.unionByName(row("constants.missing", F.lit(0), count(wanted.join(constants.select("name"), "name", "left_anti"))))
    return out.withColumn("ok", F.col("expected") == F.col("actual"))
