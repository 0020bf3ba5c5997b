"""Second moments of wide tables, whitening and small spectra.

Rows never leave their partition: each partition adds up its own Gram matrix with numpy and emits one
row of dims x dims numbers per batch group; Spark sums those. Only dims x dims matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import wide
from curatrix.session import checkpointed

MAX_DIMS = 2048


def _rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def gram(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Uncentred sums of products as rows ``(i, block)``: row ``i`` of sum(x x')."""
    if dims > MAX_DIMS:
        return wide.gram(df, vector, dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), dims)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims, dtype=np.int32), "block": list(total)},
                                         schema=pa.schema([("i", pa.int32()), ("block", pa.list_(pa.float64()))]))

    parts = df.select(vector).mapInArrow(partial, "i int, block array<double>")
    # whole matrix rows are summed: dims rows per partition are shuffled, not dims x dims
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("block"))).alias("block"))
    return rows.select("i", F.posexplode("block").alias("j", "x"))


def moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and uncentred second moment. The constant 1 rides along as one more dimension."""
    if dims >= MAX_DIMS:
        raise ValueError(f"{dims} dimensions exceed the {MAX_DIMS} a driver-side matrix may have; wide.singular_pairs takes more")
    extended = df.select(F.concat(F.array(F.lit(1.0)), F.col(vector).cast("array<double>")).alias("_v"))
    m = np.zeros((dims + 1, dims + 1))
    for r in gram(extended, "_v", dims + 1).toLocalIterator():  # dims x dims numbers
        m[r["i"], r["j"]] = r["x"]
    n = m[0, 0]
    return int(n), m[0, 1:] / max(n, 1), m[1:, 1:] / max(n, 1)


def covariance(df: DataFrame, vector: str, dims: int, sample: bool = False) -> DataFrame:
    """Centred covariance in long form (i, j, cov)."""
    # read several times: worked out once
    sums = checkpointed(gram(df.select(F.concat(F.array(F.lit(1.0)), F.col(vector)).alias("_v")), "_v", dims + 1))
    first = sums.filter("i = 0").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("m")).scalar()
    wide = sums.filter("i > 0 AND j > 0").withColumn("_m", first)
    n = F.col("_m")[F.lit(0)]
    cov = (F.col("x") - F.col("_m")[F.col("i")] * F.col("_m")[F.col("j")] / n) / (n - 1 if sample else n)
    return wide.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), cov.alias("cov"))


def whitening_matrix(second: np.ndarray, keep: float = 0.95, least: int = 128) -> np.ndarray:
    """dims x k matrix that gives the kept principal directions unit second moment."""
    values, directions = np.linalg.eigh(second)
    order = np.argsort(values)[::-1]
    values, directions = np.maximum(values[order], 0.0), directions[:, order]
    needed = int(np.searchsorted(np.cumsum(values) / values.sum(), keep) + 1)
    k = min(max(min(least, len(values)), needed), int((values > 1e-9).sum()))
    # a sign rule makes the result repeatable
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(values))])
    return (directions * signs)[:, :k] / np.sqrt(values[:k] + 1e-6)


def multiply(df: DataFrame, vector: str, weights: np.ndarray, target: str, unit_length: bool = False) -> DataFrame:
    """``vector @ weights`` per row in Arrow batches; the matrix (dims x dims at most) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights))
    dims = weights.shape[0]

    @F.pandas_udf("array<double>")
    def apply(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        out = np.stack(column.to_numpy()).reshape(-1, dims) @ shared.value
        if unit_length:
            length = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
        return pd.Series(list(out))

    return df.withColumn(target, apply(F.col(vector).cast("array<double>")))


def whiten(df: DataFrame, vector: str, dims: int, target: str = "white", keep: float = 0.95, least: int = 128,
           unit_length: bool = False) -> DataFrame:
    """Rows in the whitened space of their own uncentred second moment; beyond ``MAX_DIMS`` dimensions through leading singular pairs."""
    if dims >= MAX_DIMS:
        return multiply(df, vector, wide.whitening(df, vector, dims, keep, least), target, unit_length)
    _, _, second = moments(df, vector, dims)
    return multiply(df, vector, whitening_matrix(second, keep, least), target, unit_length)


def spectrum(df: DataFrame, vector: str, dims: int, shares: tuple[float, ...] = (0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """How many directions carry each share of variance, and the condition number."""
    n, mean, second = moments(df, vector, dims)
    values = np.sort(np.maximum(np.linalg.eigvalsh(second - np.outer(mean, mean)), 0.0))[::-1]
    upto = np.cumsum(values) / values.sum()
    positive = values[values > 1e-12]
    rows = [(f"components_{round(s * 100)}", float(np.searchsorted(upto, s) + 1)) for s in shares]
    rows += [("condition", float(positive[0] / positive[-1])), ("near_zero", float((values < 1e-9).sum()))]
    return df.sparkSession.createDataFrame(rows, "name string, value double")


def covariance_report(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Diagnostics without a spectrum: distance of the covariance to the identity, off-diagonal size, flat dimensions."""
    c = covariance(df, vector, dims)
    diagonal = F.col("i") == F.col("j")
    gap = F.col("cov") - F.when(diagonal, 1.0).otherwise(0.0)
    return c.agg(F.sqrt(F.sum(gap * gap)).alias("frobenius_to_identity"), F.avg(F.when(~diagonal, F.abs("cov"))).alias("mean_off_diagonal"),
                 F.max(F.when(~diagonal, F.abs("cov"))).alias("max_off_diagonal"), F.count_if(diagonal & (F.col("cov") < 1e-9)).alias("flat_dims"),
                 F.avg(F.when(diagonal, F.col("cov"))).alias("mean_variance"))


def correlations(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Pearson correlation of every pair of dimensions (i < j)."""
    c = covariance(df, vector, dims)
    own = c.filter("i = j").agg(F.map_from_entries(F.collect_list(F.struct("i", "cov"))).alias("m")).scalar()
    scale = F.sqrt(F.col("_v")[F.col("i")] * F.col("_v")[F.col("j")])
    return c.filter("i < j").withColumn("_v", own).select("i", "j", F.when(scale > 1e-15, F.col("cov") / scale).alias("r"))


def as_weights(rows: DataFrame, dims: int, i: str = "i", j: str = "j", value: str = "x") -> np.ndarray:
    """A small long-form matrix as numpy (at most dims x dims numbers)."""
    if dims > MAX_DIMS:
        raise ValueError("matrix too large for the driver")
    m = np.zeros((dims, dims))
    for r in rows.select(i, j, value).toLocalIterator():
        m[r[i], r[j]] = r[value]
    return m
