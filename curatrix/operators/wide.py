"""Matrices and models with more columns than a driver-side square matrix may have.

Gram matrices are worked out in stripes of columns and stay distributed. Singular pairs come from a randomized range finder: a tall, skinny product is
orthogonalized by partition-wise QR whose small factors meet in a tree, so nothing is squared. Penalized regression keeps an active set of
columns: only their products are formed, and one pass a round checks every other column against the optimality condition.
The driver holds (columns x sketch) and (active x active) numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import regression

STRIPE = 1024
FAN = 16
MAX_ACTIVE = 1000


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def summed(df: DataFrame, vector: str, dims: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of ``part(block of rows)``, a matrix of a fixed shape: partial sums in each task, then row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0), dims))
        yield pa.RecordBatch.from_pydict({"i": np.arange(shape[0], dtype=np.int32), "row": list(total)}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, row array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out = np.zeros(shape)
    for r in rows.toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def gram(df: DataFrame, vector: str, dims: int, stripe: int = STRIPE) -> DataFrame:
    """Uncentred sums of products as (i, j, x), any number of columns: a task holds one stripe of ``stripe`` x ``dims`` at a time."""
    out = None
    for first in range(0, dims, stripe):
        last = min(dims, first + stripe)

        def run(batches: Iterator[pa.RecordBatch], first: int = first, last: int = last) -> Iterator[pa.RecordBatch]:
            total = np.zeros((last - first, dims))
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0), dims)
                    total += x[:, first:last].T @ x
            yield pa.RecordBatch.from_pydict({"i": np.arange(first, last, dtype=np.int32), "row": list(total)}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

        parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, row array<double>")
        rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("i", F.posexplode("row").alias("j", "x"))


def tall_r(df: DataFrame, vector: str, weights: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """The R factor of (rows - mean) @ ``weights``: QR of every block, then of ``FAN`` stacked factors at a time, up to one."""
    dims, width = weights.shape
    shift = np.zeros(dims) if mean is None else mean

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack((held, (_matrix(batch.column(0), dims) - shift) @ weights)), mode="r")
        if len(held):
            yield pa.RecordBatch.from_pydict({"r": [held.ravel()]}, schema=pa.schema([("r", pa.list_(pa.float64()))]))

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(r).reshape(-1, width) for r in frame["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(stack, mode="r").ravel()]})

    source = df.select(F.col(vector).cast("array<double>").alias("v"))
    factors = source.mapInArrow(local, "r array<double>")
    n = source.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        factors = factors.groupBy(F.pmod(F.xxhash64("r"), F.lit(n))).applyInPandas(merged, "r array<double>")
    rows = [np.asarray(r["r"]).reshape(-1, width) for r in factors.toLocalIterator()]  # at most about FAN factors of width x width
    return np.linalg.qr(np.vstack(rows), mode="r") if rows else np.zeros((0, width))


def singular_pairs(df: DataFrame, vector: str, dims: int, k: int, centre: bool = False, extra: int = 10, rounds: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest singular values of the rows, their right vectors (dims x k) and the number of rows.

    Randomized range finder with ``rounds`` of subspace iteration; each sketch is orthogonalized through ``tall_r`` before it is multiplied back.
    """
    width = min(dims, k + extra)
    count, sums = df.count(), None
    mean = np.zeros(dims)
    if centre and count:
        sums = summed(df, vector, dims, lambda x: x.sum(axis=0, keepdims=True), (1, dims))
        mean = sums[0] / count
    base = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    back = np.zeros((dims, width))
    for _ in range(rounds):
        r = tall_r(df, vector, base, mean)
        inverse = np.linalg.pinv(r)
        turn = base @ inverse
        back = summed(df, vector, dims, lambda x, turn=turn: (x - mean).T @ ((x - mean) @ turn), (dims, turn.shape[1]))
        base = np.linalg.qr(back)[0]
    left, values, _ = np.linalg.svd(back, full_matrices=False)
    signs = np.sign(left[np.abs(left).argmax(axis=0), np.arange(left.shape[1])])
    return values[:k], (left * np.where(signs == 0, 1, signs))[:, :k], count


def whitening(df: DataFrame, vector: str, dims: int, keep: float = 0.95, least: int = 128, most: int = 512) -> np.ndarray:
    """dims x k matrix that gives the leading directions unit second moment, as ``matrix.whitening_matrix``, with at most ``most`` of them."""
    values, right, n = singular_pairs(df, vector, dims, min(most, dims))
    total = float(summed(df, vector, dims, lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0])
    share = values ** 2
    needed = int(np.searchsorted(np.cumsum(share) / max(total, 1e-300), keep) + 1)
    k = min(max(min(least, len(values)), needed), int((share / max(n, 1) > 1e-9).sum()))
    return right[:, :k] / np.sqrt(share[:k] / max(n, 1) + 1e-6)


def wide_lasso(df: DataFrame, vector: str, target: str, dims: int, alpha: float, l1_ratio: float = 1.0, tolerance: float = 1e-7, most: int = MAX_ACTIVE,
               rounds: int = 100) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of lasso or elastic net over a vector column of any width (standardized columns, as ``regression.fit``).

    The sequential strong rule picks the first columns; then rounds of a fit on the active columns and one pass that gives every column's
    gradient, which adds the worst violators until none is left, so the result is the one over all columns.
    """
    rows = df.filter(F.col(target).isNotNull()).select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("z"))

    def first(z: np.ndarray) -> np.ndarray:
        x, y = z[:, :-1], z[:, -1:]
        return np.vstack((np.append(x.sum(axis=0), y.sum()), np.append((x * x).sum(axis=0), (y * y).sum()), np.append((x * y).sum(axis=0), len(z))))

    moments = summed(rows, "z", dims + 1, first, (3, dims + 1))
    n = moments[2, -1]
    mean = moments[0] / max(n, 1)
    variance = moments[1] / max(n, 1) - mean ** 2
    flat = variance[:-1] <= 1e-10 * moments[1, :-1] / max(n, 1)
    scale = np.where(flat, 1.0, np.sqrt(np.maximum(variance[:-1], 1e-300)))
    pull = np.where(flat, 0.0, (moments[2, :-1] / max(n, 1) - mean[:-1] * mean[-1]) / scale)
    soft = alpha * l1_ratio
    top = float(np.abs(pull).max(initial=0.0))
    active = np.flatnonzero(np.abs(pull) >= max(2 * soft - top, soft))
    if len(active) > most // 2:
        active = np.sort(np.argsort(-np.abs(pull), kind="stable")[:most // 2])
    beta, level = np.zeros(dims), float(mean[-1])
    for _ in range(rounds):
        if len(active):
            width = len(active) + 2

            def products(z: np.ndarray, active: np.ndarray = active) -> np.ndarray:
                cells = np.column_stack((np.ones(len(z)), z[:, active], z[:, -1]))
                return cells.T @ cells

            m = summed(rows, "z", dims + 1, products, (width, width))
            model = regression.fit(m, range(len(active)), alpha, l1_ratio)
            beta = np.zeros(dims)
            beta[active], level = model.beta, model.intercept

        def gradient(z: np.ndarray, beta: np.ndarray = beta, level: float = level) -> np.ndarray:
            gap = z[:, -1] - level - z[:, :-1] @ beta
            return ((z[:, :-1] - mean[:-1]) * gap[:, None]).sum(axis=0, keepdims=True)

        slope = np.abs(np.where(flat, 0.0, summed(rows, "z", dims + 1, gradient, (1, dims))[0] / max(n, 1) / scale))
        slope[active] = 0.0
        missed = np.flatnonzero(slope > soft + tolerance * max(1.0, top))
        if not len(missed):
            return level, beta
        keep = active[beta[active] != 0] if len(active) + len(missed) > most else active
        room = most - len(keep)
        if room <= 0:
            raise ValueError(f"more than {most} columns are needed at this penalty")
        active = np.union1d(keep, missed[np.argsort(-slope[missed], kind="stable")[:min(room, max(10, len(keep)))]])
    raise ValueError("the active set did not settle")


def wide_predict(df: DataFrame, vector: str, level: float, beta: np.ndarray, target: str = "predicted") -> DataFrame:
    """Level plus vector times coefficients; only the columns with a coefficient are read."""
    used = np.flatnonzero(beta)
    total = F.lit(float(level))
    for i in used:
        total = total + F.get(F.col(vector), F.lit(int(i))) * F.lit(float(beta[i]))
    return df.withColumn(target, total)
