"""Sums of weights leave a task in batches of bounded size."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from curatrix.operators import playtime


@pytest.mark.parametrize("cells", [1 << 19, 60, 1])
def test_batches_of_sums_are_bounded_and_whole(monkeypatch, cells):
    monkeypatch.setattr(playtime, "POINT_CELLS", cells)
    rng = np.random.default_rng(1)
    xs = [np.sort(rng.choice(40, n, replace=False) + 1.0) for n in (3, 1, 7, 5, 2, 6)]
    ups = [rng.integers(0, 3, len(x)).astype(float) for x in xs]
    gammas = np.array([0.2, 0.7, 2.0])
    batch = pa.record_batch({"appid": pa.array(range(6), pa.int64()), "x": [list(x) for x in xs], "kx": [list(x) for x in xs], "kn": [list(u + 1) for u in ups], "kup": [list(u) for u in ups]}).slice(1)
    out = list(playtime.weighted_votes(batch, gammas))
    assert all(b.num_rows <= max(cells // 3, 7) for b in out) and (len(out) == 1) == (cells > 60)
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["appid"], r["x"]) for r in rows] == [(i, x) for i in range(1, 6) for x in xs[i]]
    for r in rows:
        i = r["appid"]
        for j, g in enumerate(gammas):
            w = np.exp(-0.5 * ((np.log(r["x"] + 1e-9) - np.log(xs[i] + 1e-9)) / g) ** 2)
            assert (r["total"][j], r["positive"][j]) == (pytest.approx(w @ (ups[i] + 1)), pytest.approx(w @ ups[i]))


def histogram(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(n), float(rng.integers(0, n + 1))) for i in range(6) for x, n in zip(rng.choice(50, 3 + i * 3, replace=False) + 1, rng.integers(1, 4, 3 + i * 3))]
    return spark.createDataFrame(rows, "appid long, x double, n double, up double"), rows


@pytest.mark.parametrize("chunk", [2048, 8])
def test_likelihoods_of_long_and_short_items(spark, monkeypatch, chunk):
    monkeypatch.setattr(playtime, "CHUNK", chunk)
    monkeypatch.setattr(playtime, "POINT_CELLS", 30)
    df, rows = histogram(spark)
    got = {(r["width"], r["prior"]): r["log_likelihood"] for r in playtime.likelihood_grid(df, 0.8, [0.2, 0.9], [0.5, 3.0]).collect()}
    assert set(got) == {(w, s) for w in (0.2, 0.9) for s in (0.5, 3.0)}
    for (width, s), value in got.items():
        want = 0.0
        for i, x, n, up in rows:
            w = [(np.exp(-0.5 * ((np.log(x + 1e-9) - np.log(y + 1e-9)) / width) ** 2), m, u) for j, y, m, u in rows if j == i]
            t, p = sum(a * m for a, m, _ in w), sum(a * u for a, _, u in w)
            base = max(t - 1 + s, 1e-12)
            yes, no = (np.clip(v / base, 1e-12, 1 - 1e-12) for v in (p - 1 + s * 0.8, p + s * 0.8))
            want += up * np.log(yes) + (n - up) * np.log1p(-no)
        assert value == pytest.approx(want)


def test_sums_of_short_items_are_not_shuffled(spark):
    df, _ = histogram(spark)
    plan = playtime.likelihood_grid(df, 0.8, [0.2, 0.9], [0.5]).withColumn("one", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Union" in plan


def test_logs_of_products_equal_counted_logs():
    rng = np.random.default_rng(9)
    for counts in (rng.integers(1, 14, 70), np.ones(37), np.array([9.0]), np.array([8.0, 2.0, 1.5]), np.zeros(0)):
        c = np.sort(np.asarray(counts, float))[::-1]
        x = rng.choice([1e-12, 0.3, 1 - 1e-12, 0.9], (len(c), 5))
        assert playtime.log_powers(x.copy(), c) == pytest.approx(c @ np.log(x))


def test_short_items_are_dealt_over_all_tasks(spark):
    grid = playtime.likelihood_grid(histogram(spark)[0], 0.7, [0.2], [1.0])
    assert grid.count() == 1
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(appid" in plan and "REPARTITION_BY_NUM" in plan
