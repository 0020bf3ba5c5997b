"""Common factors of a table's columns: uniquenesses by expectation maximization, then a varimax rotation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from curatrix.operators import matrix


def correlation_matrix(df: DataFrame, vector: str, dims: int) -> np.ndarray:
    """Correlations of the columns; a constant column correlates with none."""
    _, mean, second = matrix.moments(df, vector, dims)
    cov = second - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = d <= 1e-9 * np.sqrt(np.maximum(np.diag(second), 1e-300))
    d = np.where(flat, 1.0, d)
    r = np.where(flat[:, None] | flat[None, :], 0.0, cov / np.outer(d, d))
    np.fill_diagonal(r, 1.0)
    return r


def common_factors(r: np.ndarray, k: int, rounds: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns x k) and uniquenesses of the factor model r = L L' + diag(u) by maximum likelihood."""
    values, directions = np.linalg.eigh(r)
    k = min(k, len(r))
    lead = np.argsort(values)[::-1][:k]
    load = directions[:, lead] * np.sqrt(np.maximum(values[lead], 1e-6))
    unique = np.clip(1 - (load ** 2).sum(axis=1), 0.005, 1.0)
    for _ in range(rounds):
        scaled = load / unique[:, None]
        spread = np.linalg.inv(np.eye(k) + load.T @ scaled)
        beta = spread @ scaled.T
        cross = r @ beta.T
        moment = spread + beta @ cross
        fresh = cross @ np.linalg.inv(moment)
        level = np.clip(np.diag(r) - (fresh * cross).sum(axis=1), 0.005, 1.0)
        moved = max(np.abs(fresh - load).max(), np.abs(level - unique).max())
        load, unique = fresh, level
        if moved < tolerance:
            break
    return load, unique


def varimax(load: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Rotation of loadings towards few large ones a factor (rows scaled to unit length while turning)."""
    length = np.sqrt((load ** 2).sum(axis=1, keepdims=True))
    a = load / np.where(length > 0, length, 1)
    turn, last = np.eye(a.shape[1]), 0.0
    for _ in range(rounds):
        b = a @ turn
        left, size, right = np.linalg.svd(a.T @ (b ** 3 - b * (b ** 2).mean(axis=0)))
        turn = left @ right
        if size.sum() <= last * (1 + tolerance):
            break
        last = size.sum()
    return load @ turn


def factor_loadings(df: DataFrame, vector: str, names: Sequence[str], factors: int = 20) -> DataFrame:
    """Rotated loadings of the common factors in long form (factor, feature, loading, communality), strongest factor first, its largest loading positive."""
    load, _ = common_factors(correlation_matrix(df, vector, len(names)), factors)
    load = varimax(load)
    load = load[:, np.argsort(-(load ** 2).sum(axis=0), kind="stable")]
    load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1, 1)
    shared = (load ** 2).sum(axis=1)
    rows = [(int(f), names[i], float(load[i, f]), float(shared[i])) for f in range(load.shape[1]) for i in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "factor int, feature string, loading double, communality double")


def factor_of(loadings: DataFrame, feature: str) -> DataFrame:
    """The factor on which one feature loads most, turned so that it loads positively: (feature, loading)."""
    from pyspark.sql import functions as F
    own = loadings.filter(F.col("feature") == feature).agg(F.max_by(F.struct("factor", "loading"), F.struct(F.abs("loading"), -F.col("factor"))).alias("b")).scalar()
    hit = loadings.withColumn("_b", own).filter(F.col("factor") == F.col("_b.factor"))
    return hit.select("factor", "feature", (F.col("loading") * F.when(F.col("_b.loading") < 0, -1.0).otherwise(1.0)).alias("loading"))
