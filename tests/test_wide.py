"""Wide matrices, factor analysis and blocked lasso against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import factors, regression, wide
from curatrix.plans import difficulty


def vectors(spark, x, extra=None):
    rows = [(i, [float(v) for v in line], None if extra is None else float(extra[i])) for i, line in enumerate(x)]
    return spark.createDataFrame(rows, "appid long, vec array<double>, y double").repartition(5)


def low_rank(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, 12)) * 0.7 ** np.arange(12)) @ rng.standard_normal((12, dims)) + 0.01 * rng.standard_normal((n, dims))


def test_gram_in_stripes(spark):
    x = low_rank(40, 9)
    want = x.T @ x
    got = np.zeros((9, 9))
    for r in wide.gram(vectors(spark, x), "vec", 9, stripe=4).collect():
        got[r["i"], r["j"]] = r["x"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("centre", [False, True])
def test_singular_pairs_of_five_thousand_columns(spark, centre):
    x = low_rank(120, 5000) + (2.0 if centre else 0.0)
    values, right, n = wide.singular_pairs(vectors(spark, x), "vec", 5000, 8, centre=centre)
    left, want, turned = np.linalg.svd(x - x.mean(axis=0) if centre else x, full_matrices=False)
    assert n == 120 and values == pytest.approx(want[:8], rel=1e-8)
    assert np.abs(np.abs((turned[:8] * right.T).sum(axis=1)) - 1).max() < 1e-8


def test_tall_factor_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(wide, "FAN", 2)
    x = low_rank(60, 30)
    w = np.random.default_rng(1).standard_normal((30, 4))
    r = wide.tall_r(vectors(spark, x), "vec", w)
    assert r.T @ r == pytest.approx((x @ w).T @ (x @ w))


def test_whitening_of_wide_rows(spark, monkeypatch):
    from curatrix.operators import matrix
    monkeypatch.setattr(matrix, "MAX_DIMS", 50)
    x = low_rank(100, 80)
    white = np.array([r["white"] for r in matrix.whiten(vectors(spark, x), "vec", 80, keep=0.99, least=4).orderBy("appid").collect()])
    assert white.T @ white / 100 == pytest.approx(np.eye(white.shape[1]), abs=1e-3) and 4 <= white.shape[1] <= 14
    sums = {(r["i"], r["j"]): r["x"] for r in matrix.gram(vectors(spark, x), "vec", 80).collect()}
    assert len(sums) == 6400 and sums[3, 70] == pytest.approx(x[:, 3] @ x[:, 70])


def test_learning_grid_equals_refits_on_nested_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 4))
    y = x @ [1.0, 0.5, 0.0, 0.0] + rng.standard_normal(200)
    df = spark.createDataFrame([(i, *[float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "appid long, a double, b double, c double, d double, y double")
    draw = {r["appid"]: (r["u"], r["f"]) for r in df.select("appid", (F.pmod(F.xxhash64("appid", F.lit(7)), F.lit(1_000_000)) / 1e6).alias("u"), regression.fold_of(F.col("appid")).alias("f")).collect()}
    table = regression.learning_grid(df, list("abcd"), "y", F.col("appid"), [0.3, 1.0], [1, 4], [1.0])
    for row in table.itertuples():
        held = np.array([draw[i][0] < row.share for i in range(200)])
        fold = np.array([draw[i][1] for i in range(200)])
        assert row.n == held.sum()
        order = np.argsort([-abs(np.corrcoef(x[held, j], y[held])[0, 1]) for j in range(4)])[:row.k]
        scores = []
        for f in range(5):
            a, b = held & (fold != f), held & (fold == f)
            m, s = x[a][:, order].mean(axis=0), x[a][:, order].std(axis=0)
            z = (x[a][:, order] - m) / s
            beta = np.linalg.solve(z.T @ z + np.eye(row.k), z.T @ (y[a] - y[a].mean()))
            guess = y[a].mean() + (x[b][:, order] - m) / s @ beta
            scores.append(1 - ((y[b] - guess) ** 2).sum() / ((y[b] - y[b].mean()) ** 2).sum())
        assert row.r2 == pytest.approx(np.mean(scores))


@pytest.mark.parametrize("ratio, alpha", [(1.0, 0.05), (1.0, 0.5), (0.5, 0.05), (1.0, 100.0)])
def test_wide_lasso_equals_coordinate_descent(spark, ratio, alpha):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 40)) * rng.uniform(0.5, 3, 40) + rng.uniform(-2, 2, 40)
    x[:, 7], x[:, 8] = 4.0, x[:, 9]
    y = 3 + x[:, 0] * 2 - x[:, 3] + 0.3 * x[:, 20] + 0.1 * rng.standard_normal(150)
    z = np.column_stack((np.ones(150), x, y))
    want = regression.fit(z.T @ z, range(40), alpha, ratio, rounds=20000)
    level, beta = wide.wide_lasso(vectors(spark, x, y), "vec", "y", 40, alpha, ratio)
    assert z[:, :-1] @ np.append(level, beta) == pytest.approx(z[:, :-1] @ np.append(want.intercept, want.beta), abs=1e-5)
    others = [i for i in range(40) if i not in (8, 9)]
    assert beta[others] == pytest.approx(want.beta[others], abs=1e-5)


def test_more_columns_than_a_driver_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((100, 3000))
    y = x[:, 17] * 3 - x[:, 2500] * 2
    level, beta = wide.wide_lasso(vectors(spark, x, y), "vec", "y", 3000, 0.3)
    scale = x.std(axis=0)
    slope = ((x - x.mean(axis=0)) * (y - level - x @ beta)[:, None]).mean(axis=0) / scale
    assert np.abs(slope).max() <= 0.3 + 1e-6 and {17, 2500} <= set(np.flatnonzero(beta)) and np.abs(slope[np.flatnonzero(beta)]) == pytest.approx(0.3, abs=1e-6)
    out = wide.wide_predict(vectors(spark, x, y), "vec", level, beta).orderBy("appid").collect()
    assert [r["predicted"] for r in out] == pytest.approx(list(level + x @ beta))


def planted(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    load = np.zeros((12, 3))
    load[0:4, 0], load[4:8, 1], load[8:12, 2] = (0.9, 0.8, 0.7, 0.6), (0.85, 0.75, 0.65, 0.55), (0.8, 0.8, 0.6, -0.5)
    unique = 1 - (load ** 2).sum(axis=1)
    return rng.standard_normal((n, 3)) @ load.T + rng.standard_normal((n, 12)) * np.sqrt(unique), load


def test_simple_structure_is_found(spark):
    x, load = planted()
    names = [f"f{i:02d}" for i in range(12)]
    rows = factors.factor_loadings(vectors(spark, x * 3 + 1), "vec", names, 3).collect()
    got = np.zeros((12, 3))
    for r in rows:
        got[names.index(r["feature"]), r["factor"]] = r["loading"]
    order = [int(np.abs(got.T @ load[:, j]).argmax()) for j in range(3)]
    assert sorted(order) == [0, 1, 2] and np.abs(np.abs(got[:, order]) - np.abs(load)).max() < 0.08
    turned = factors.factor_of(spark.createDataFrame(rows), "f11").collect()
    assert {r["feature"]: r["loading"] for r in turned}["f11"] > 0 and len({r["factor"] for r in turned}) == 1


def test_rotation_keeps_communalities_and_the_model():
    x, _ = planted()
    r = np.corrcoef(x.T)
    load, unique = factors.common_factors(r, 3)
    turned = factors.varimax(load)
    assert (turned ** 2).sum(axis=1) == pytest.approx((load ** 2).sum(axis=1)) and turned @ turned.T == pytest.approx(load @ load.T)
    assert np.abs(load @ load.T + np.diag(unique) - r).max() < 0.05
    assert (turned ** 4).sum() >= (load ** 4).sum()


def test_difficulty_model_finds_what_makes_it(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 6))
    features = spark.createDataFrame([(i, [float(v) for v in line]) for i, line in enumerate(x)], "appid long, vec array<double>")
    items = spark.createDataFrame([(i, f"Title {i} of the sea") for i in range(300)], "appid long, name string")
    rated = spark.createDataFrame([(f"TITLE {i} of the Sea!", float(np.clip(3 + x[i, 2] - 0.5 * x[i, 4], 1, 5))) for i in range(0, 300, 2)] + [("unknown", 2.0), ("title 4 of the sea", None)], "title string, difficulty double")
    labelled = difficulty.labels(rated, items)
    assert labelled.count() == 150
    predicted, coefficients = difficulty.difficulty_model(features, labelled, [f"x{i}" for i in range(6)])
    found = {r["feature"]: r["coefficient"] for r in coefficients.collect()}
    assert found["x2"] > 0.5 and found["x4"] < -0.2 and max((abs(v) for k, v in found.items() if k not in ("x2", "x4")), default=0) < 0.2
    out = {r["appid"]: r["difficulty_predicted"] for r in predicted.collect()}
    assert len(out) == 300 and np.corrcoef([out[i] for i in range(300)], x[:, 2] - 0.5 * x[:, 4])[0, 1] > 0.95 and min(out.values()) >= 0 and max(out.values()) <= 10
    neutral, none = difficulty.difficulty_model(features, labelled.filter("false"), [f"x{i}" for i in range(6)])
    assert {r["difficulty_predicted"] for r in neutral.collect()} == {5.0} and none.count() == 0
