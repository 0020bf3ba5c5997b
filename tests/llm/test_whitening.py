"""Whitening against numpy's eigenvectors, the eigensolver against dense matrices."""

import math

import numpy as np
import pytest

from curatrix.llm import whitening

SHAPE = "vec_id long, embedding array<float>, n int"


@pytest.mark.parametrize("dims, kind", [(64, "flat"), (200, "flat"), (200, "falling"), (40, "rank"), (3, "flat"), (30, "equal"), (1, "flat")])
def test_pairs_at_double_precision(dims, kind):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((1000, dims))
    if kind == "falling":
        x *= 0.96 ** np.arange(dims)
    if kind == "rank":
        x = x[:, :5] @ rng.standard_normal((5, dims))
    matrix = np.eye(dims) if kind == "equal" else x.T @ x / 1000
    values, vectors = whitening.leading_pairs(lambda b: matrix @ b, dims, 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14


def test_inner_systems_are_solved():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    a, b = a + a.T, rng.standard_normal((20, 3))
    b[:, 1] = 0
    got = whitening.minres(lambda v: a @ v, b, 60, 1e-12)
    assert np.abs(a @ got - b).max() < 1e-8 and not got[:, 1].any()


def brute(rows, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}))
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [(i, n, int(((n * np.array(v) - sums) ** 2).sum()), ((n * np.array(v) - sums) / n) @ vectors / np.sqrt(values)) for i, v in kept], values / np.trace(c.T @ c / n)


def test_equals_dense_whitening(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * (1, 2, 3, 4, 5, 6)]) for i in range(60)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (72, [float("nan")] * 6), (73, [float("inf")] * 6), (74, [0.0] * 6), rows[5]]
    out = whitening.whitened(spark.createDataFrame([(i, v, 1) for i, v in rows], SHAPE), components=4).toPandas()
    want, share = brute(rows, 4)
    assert len(out) == 4 * len(want) and (out["identity_error"] < 1e-12).all()
    signs = {}
    by_row = {}
    for (key, part) in out.groupby([out["vec_id"].fillna(-1), "deviation"]):
        by_row[key] = part.sort_values("component")
    for i, n, deviation, line in want:
        part = by_row[(-1 if i is None else i, deviation)]
        assert (part["n"] == n).all() and len(part) % 4 == 0
        for component, value, explained in zip(part["component"], part["whitened"], part["explained"]):
            assert explained == pytest.approx(share[component - 1], rel=1e-10)
            assert abs(value) == pytest.approx(abs(line[component - 1]), rel=1e-9, abs=1e-10)
            if abs(value) > 1e-6:
                assert signs.setdefault(component, np.sign(value * line[component - 1])) == np.sign(value * line[component - 1])


def test_long_deviation_is_exact_or_null():
    big = np.array([[2 ** 40, 0]])
    assert whitening._squares(big, 1, np.array([0, 0])).to_pylist() == [None]
    assert whitening._squares(np.array([[2 ** 31 - 1, 1]]), 1, np.array([0, 0])).to_pylist() == [(2 ** 31 - 1) ** 2 + 1]


def test_lengths_and_nothing_that_varies(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0), (3, [5.0], 0), (4, [5.0], 0), (5, [], 0), (6, [1.0] * 3, 0), (7, [2.0] * 3, 0)]
    out = whitening.whitened(spark.createDataFrame(rows, SHAPE)).toPandas()
    assert sorted(out["vec_id"]) == [1, 2, 6, 7] and np.allclose(out["whitened"].abs(), 1) and np.allclose(out["explained"], 1)
    assert whitening.whitened(spark.createDataFrame([], SHAPE)).count() == 0
