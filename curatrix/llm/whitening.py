"""Embedding whitening by a block Jacobi-Davidson eigensolver whose every product runs on Spark.

Every entry c becomes the integer ``floor(scale * c) + shift``. The covariance V of the distinct integer vectors (divisor n) is never
formed: a product V B is one pass over the stored vectors, where each task centres its rows exactly (``n * x - S`` in integers), multiplies and
returns partial sums of dims x columns. The driver holds blocks of dims x (components + subspace) doubles and nothing that grows with the rows.

One outer step does Rayleigh-Ritz in the search space, locks leading pairs whose residual is at double precision, and expands the space by
approximate solutions t of ``(I - QQ')(V - theta I)(I - QQ') t = -r`` (Q: locked vectors and the Ritz vector), all of them at once by inner MINRES.
A full search space restarts from its best Ritz vectors. It ends when all wanted pairs are locked.

Rows whose vector is null, or holds null or non-finite entries, are dropped; zero vectors, repeated rows and null vec_ids stay (a repeated vector
is fitted once and returned for each row). Vectors of different lengths are spaces of their own, each with its own fit. Directions without
variance (at rounding level) have no whitened value and are no components, so equal vectors, empty vectors or a single row give no
rows; so does an empty table. ``deviation`` is null where it exceeds a long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.storage import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
WIDTH = 16
INNER = 6
CELLS = 1 << 21
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Fit:
    """Whitening of vectors of one length: sums of the n fitted vectors, unit eigenvectors (dims x components) and their eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    products: int


def integer_vectors(rows: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that stay; x holds longs."""
    wide = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return wide.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def _slices(batch: pa.RecordBatch, dims: int):
    """The rows of a batch as int64 matrices of a bounded size, with the number of the first row."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)
    step = max(1, CELLS // dims)
    for at in range(0, len(batch), step):
        yield at, x[at:at + step]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)


def _summed(frame: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part(rows)`` over all rows, of a fixed shape: partial sums in each task, then one number a cell."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in _slices(batch, dims):
                more = part(x)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    out = np.zeros(int(np.prod(shape)))
    cells = frame.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out[cells["cell"].to_numpy(np.int64)] = cells["value"].to_numpy(np.float64)
    return out.reshape(shape)


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Minimum residual solutions of symmetric systems, one a column, which share each product; stops when all residuals fell by ``drop``."""
    size = np.linalg.norm(right, axis=0)
    live = size > 0
    x = np.zeros_like(right)
    v, old = right / np.where(live, size, 1), np.zeros_like(right)
    w, w_old = np.zeros_like(right), np.zeros_like(right)
    beta, eta = size.copy(), size.copy()
    c = c_old = np.ones(len(size))
    s = s_old = np.zeros(len(size))
    for _ in range(steps):
        image = product(v)
        alpha = (v * image).sum(axis=0)
        ahead = image - alpha * v - beta * old * (np.abs(old).sum(axis=0) > 0)
        beta_next = np.linalg.norm(ahead, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.sqrt(delta ** 2 + beta_next ** 2)
        live &= rho > 0
        rho = np.where(live, rho, 1)
        w, w_old = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / rho, w
        c, c_old, s, s_old = np.where(live, delta / rho, c), c, np.where(live, beta_next / rho, s), s
        x += np.where(live, c * eta, 0) * w
        eta = np.where(live, -s * eta, eta)
        live &= beta_next > _EPS * size
        if not live.any() or (np.abs(eta[live]) <= drop * size[live]).all():
            break
        v, old, beta = ahead / np.where(beta_next > 0, beta_next, 1), v, beta_next
    return x


def _fresh(block: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to orthonormal ``spaces`` (two rounds of Gram-Schmidt)."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        for space in spaces:
            block = block - space @ (space.T @ block)
        if not block.shape[1]:
            break
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-8]
    return block


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 12, tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite operator and their unit vectors by Jacobi-Davidson with locking.

    A residual counts as double precision at ``4 * eps * sqrt(dims)`` times the largest eigenvalue, or where it no longer falls
    though it is below a hundred times that.
    """
    k = min(k, dims)
    tolerance = tolerance or 4 * _EPS * np.sqrt(dims)
    limit = min(dims, 4 * k + WIDTH)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dims, 0)), []
    base = np.linalg.qr(rng.standard_normal((dims, min(dims, k + WIDTH // 2))))[0]
    image = product(base)
    scale, last = 0.0, np.inf
    while True:
        inner = base.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        base, image = base @ turn, image @ turn
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        rest = image - base * theta
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        whole = base.shape[1] + locked.shape[1] >= dims
        ahead = norms[:k - len(values)]
        stuck = ahead.max(initial=0) <= 100 * tolerance * scale and ahead.max(initial=0) > last / 2
        last = ahead.max(initial=0)
        good = 0
        while good < len(ahead) and (whole or stuck or ahead[good] <= tolerance * scale):
            good += 1
        if good:
            locked, values, last = np.hstack((locked, base[:, :good])), values + list(theta[:good]), np.inf
            base, image, rest, theta, norms = base[:, good:], image[:, good:], rest[:, good:], theta[good:], norms[good:]
        if len(values) >= k:
            return np.array(values), np.linalg.qr(locked)[0] * np.sign((np.linalg.qr(locked)[0] * locked).sum(axis=0))
        open_ = [j for j in range(min(len(theta), k - len(values))) if norms[j] > tolerance * scale / 4][:WIDTH]
        if base.shape[1] + len(open_) > limit - locked.shape[1]:
            keep = min(base.shape[1], max(k - len(values) + WIDTH // 2, limit - locked.shape[1] - 2 * WIDTH))
            base, image = base[:, :keep], image[:, :keep]
        ritz, shift = base[:, open_], theta[open_]

        def projected(block):
            block = block - locked @ (locked.T @ block)
            return block - ritz * (ritz * block).sum(axis=0)

        if open_:
            steps = minres(lambda b: projected(product(projected(b)) - projected(b) * shift), -projected(rest[:, open_]), INNER, 0.05)
        else:
            steps = np.zeros((dims, 0))
        more = _fresh(steps, locked, base) if steps.shape[1] else steps
        if not more.shape[1]:
            more = _fresh(rng.standard_normal((dims, min(WIDTH, dims - base.shape[1] - locked.shape[1]))), locked, base)
        more = more[:, :max(1, dims - base.shape[1] - locked.shape[1])]
        base, image = np.hstack((base, more)), np.hstack((image, product(more)))


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Fit | None:
    """Whitening of the distinct vectors x of length ``dims``; none if nothing varies."""
    distinct = stored(rows.select("x").distinct(), "whitening")
    n = distinct.count()
    if not n or not dims:
        return None
    place = distinct.select(F.posexplode("x").alias("cell", "value")).groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = np.zeros(dims, np.int64)
    for row in place:
        sums[row["cell"]] = int(row["value"])
    trace = float(_summed(distinct, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0), dims, (dims,)).sum() / n)
    if not trace:
        return None
    done = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal done
        out = []
        for at in range(0, block.shape[1], WIDTH):
            part = np.ascontiguousarray(block[:, at:at + WIDTH])

            def times(x):
                c = _centred(x, n, sums)
                return c.T @ (c @ part)

            out.append(_summed(distinct, times, dims, part.shape) / n)
            done += 1
        return np.hstack(out)

    values, vectors = leading_pairs(product, dims, components)
    real = values > 64 * _EPS * dims * trace
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    turned = vectors / np.sqrt(values)

    def moments(x):
        w = _centred(x, n, sums) @ turned
        return np.vstack((w.T @ w, w.sum(axis=0)))

    found = _summed(distinct, moments, dims, (k + 1, k)) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0))
    return Fit(n, sums, vectors, values, trace, error, done)


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
    d = n * x - sums
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2 ** 62:
        return pa.array((d * d).sum(axis=1))
    big = [int(v) for v in (d.astype(object) ** 2).sum(axis=1)]
    return pa.array([v if v < 2 ** 63 else None for v in big], pa.int64())


def transformed(rows: DataFrame, found: Fit) -> DataFrame:
    """Per row of (vec_id, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    turned, k, dims = found.vectors / np.sqrt(found.values), len(found.values), len(found.sums)
    share = found.values / found.trace

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _slices(batch, dims):
                w = _centred(x, found.n, found.sums) @ turned
                own = pa.array(np.repeat(np.arange(at, at + len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, found.n)),
                     _squares(x, found.n, found.sums).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.ravel()), pa.array(np.tile(share, len(x))),
                     pa.array(np.full(len(x) * k, found.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, _OUT)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Whitened rows of a table (vec_id, ``column``), each length with its own fit."""
    vectors = integer_vectors(rows, column, scale, shift)
    out = rows.sparkSession.createDataFrame([], _OUT)
    for (dims,) in vectors.select(F.size("x").alias("n")).distinct().orderBy("n").collect():
        own = vectors.where(F.size("x") == dims)
        found = fit(own, dims, components)
        if found is not None:
            out = out.unionByName(transformed(own, found))
    return out
