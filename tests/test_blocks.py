"""What travels between tasks where users meet items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import aggregates, kernel, pairs, taste


def vectors(spark, n, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, 4))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "appid long, vec array<double>"), m


def test_a_rated_item_travels_once_a_block_however_many_rate_it(spark, monkeypatch):
    monkeypatch.setattr(pairs, "USER_ROWS", 2)
    items, _ = vectors(spark, 5)
    rated = spark.createDataFrame([(u, u % 5, 7.0) for u in range(3000)], "user_id long, appid long, rating double")
    left, right = pairs._rated_blocks(items, items, rated, None, ["rating"], "appid")
    blocks, pieces = (left.select(c).distinct().count() for c in ("_block", "_piece"))
    assert blocks == 3 and right.count() == 5 * blocks * pieces
    assert right.filter("_piece = 0").agg(F.sum(F.size("_user_ids"))).first()[0] == 3000


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_chunks_of_users_and_mixed_powers_give_the_plain_projection(spark, monkeypatch, cells):
    monkeypatch.setattr(pairs, "SUM_CELLS", cells)
    monkeypatch.setattr(pairs, "TILE", 16)
    items, m = vectors(spark, 40)
    rng = np.random.default_rng(2)
    rows = [(u, int(a), float(rng.normal()), float(u % 3)) for u in range(7) for a in rng.choice(40, 2 + 5 * u, replace=False)]
    known = spark.createDataFrame(rows, "user_id long, appid long, residual double, power double").join(items, "appid")
    models = spark.createDataFrame([(u, ["x"], 5.0, [0.5]) for u in range(7)], "user_id long, features array<string>, intercept double, beta array<double>")
    top = taste.project_top(items.withColumn("x", F.col("appid") / 40.0), known, models, ["x"], 6, [("vec", 1.0)], None)
    got = {}
    for r in top.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["appid"], round(r["projected_rating"], 9)))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for u in range(7):
        value = {}
        for i in range(40):
            s = np.array([(unit[i] @ unit[a]) if a != i else 0.0 for v, a, _, _ in rows if v == u])
            e = np.array([x for v, _, x, _ in rows if v == u])
            w = np.sign(s) * np.abs(s) ** float(u % 3)
            value[i] = float(np.clip(5.0 + 0.5 * i / 40 + ((w @ e) / np.abs(w).sum() if np.abs(w).sum() > 0 else 0.0), 0, 10))
        want = sorted(value.items(), key=lambda x: (-round(x[1], 9), x[0]))[:6]
        assert [a for a, _ in got[u]] == [a for a, _ in want] and [x for _, x in got[u]] == pytest.approx([x for _, x in want], abs=1e-8)


def test_duplicate_rows_of_an_item_count_each(spark):
    items, m = vectors(spark, 6)
    rated = spark.createDataFrame([(1, 0, 9.0), (1, 1, 2.0)], "user_id long, appid long, rating double")
    once, twice = ({r["appid"]: r["x_graph"] for r in kernel.graph_feature(x, rated, k=6).collect()} for x in (items, items.union(items.filter("appid = 0"))))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = max(unit[3] @ unit[0], 0), max(unit[3] @ unit[1], 0)
    assert once[3] == pytest.approx((a * 4 - b * 3) / (a + b + 1e-9), abs=1e-6)
    assert twice[3] == pytest.approx((2 * a * 4 - b * 3) / (2 * a + b + 1e-9), abs=1e-6)


def test_short_lists_share_blocks(spark):
    items, _ = vectors(spark, 30)
    rated = spark.createDataFrame([(u, (u + i) % 30) for u in range(400) for i in range(3)], "user_id long, appid long")

    def work(rows, known):
        users = len(set(rows["user_id"]))
        assert len(rows) <= 128 and (~taste.apart(rows, known)).sum() == 6 * users
        return rows.assign(n=users)[["user_id", "appid", "n"]].iloc[:1]

    calls = taste.within_user_blocks(rated, work, "user_id long, appid long, n long").collect()
    assert sum(r["n"] for r in calls) == 400 and len(calls) < 60


def test_users_of_a_block_do_not_mix(spark):
    items, m = vectors(spark, 30)
    rng = np.random.default_rng(5)
    rows = [(u, int(a), int(rng.integers(0, 11))) for u in range(12) for a in rng.choice(30, 2 + u % 4, replace=False)]
    rated = spark.createDataFrame(rows, "user_id long, appid long, rating int").join(items, "appid")
    got = {(r["user_id"], r["appid"]): r["predicted"] for r in taste.loo_alternatives(rated, {"exp": ("exp", 5.0)}, [("vec", 1.0)]).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for u, a, _ in rows:
        mine = [(b, r) for v, b, r in rows if v == u]
        mean = np.mean([r for _, r in mine])
        w = np.array([np.exp(5 * (unit[a] @ unit[b] - 1)) for b, _ in mine if b != a])
        y = np.array([r for b, r in mine if b != a])
        assert got[u, a] == pytest.approx(mean + (w @ (y - mean)) / w.sum())


def test_steps_are_spread_after_a_users_rows_met(spark):
    rated = spark.createDataFrame([(u, a, (u * a) % 7) for u in range(5) for a in range(9)], "user_id long, appid long, rating int")
    grid = spark.createDataFrame([(s, a, float((a * (s + 2)) % 5)) for s in range(3) for a in range(9)], "step int, appid long, q double")
    best = taste.best_step(rated, grid)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(user_id" in x and "step" in x]
    for r in best.collect():
        y = np.array([(r["user_id"] * a) % 7 for a in range(9)], float)
        fits = [np.corrcoef([(a * (s + 2)) % 5 for a in range(9)], y)[0, 1] if y.std() else -2.0 for s in range(3)]
        assert r["step"] == int(np.argmax(np.round(fits, 12)))


def test_tags_are_spread_after_a_users_rows_met(spark):
    rated = spark.createDataFrame([(u, a, (u * a) % 11) for u in range(4) for a in range(40)], "user_id long, appid long, rating int")
    tags = spark.createDataFrame([(a, t) for a in range(40) for t in ("x", "y", None) if (a + len(t or "")) % 3], "appid long, tag string")
    effects = aggregates.tag_effects(rated, tags)
    plan = effects._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(user_id" in x and "tag#" in x]
    got = {(r["user_id"], r["tag"]): r for r in effects.collect()}
    pairs_ = {(a, t) for a in range(40) for t in ("x", "y", None) if (a + len(t or "")) % 3}
    assert len(got) == 12
    for (u, t), r in got.items():
        on, off = ([(u * a) % 11 for a in range(40) if ((a, t) in pairs_) == have] for have in (True, False))
        assert (r["n_with"], r["n_without"]) == (len(on), len(off)) and r["diff"] == pytest.approx(np.mean(on) - np.mean(off))



def test_tags_travel_as_places_in_the_vocabulary(spark):
    rated = spark.createDataFrame([(u, a, (u * a) % 11) for u in range(4) for a in range(40)], "user_id long, appid long, rating int")
    tags = spark.createDataFrame([(a, f"a long name {a % 3}") for a in range(40)], "appid long, tag string")
    effects = aggregates.tag_effects(rated, tags)
    assert "array_position" in effects._jdf.queryExecution().optimizedPlan().toString()
    assert {r["tag"] for r in effects.collect()} == {f"a long name {i}" for i in range(3)}


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_vectors_of_short_lists_are_dealt_out_once(spark):
    items, _ = vectors(spark, 30)
    rated = spark.createDataFrame([(u, (u + i) % 30) for u in range(40) for i in range(3)], "user_id long, appid long").join(items, "appid").checkpoint()
    found = taste.within_user_blocks(rated, lambda rows, known: rows[["user_id", "appid"]], "user_id long, appid long")
    assert found.count() == 120
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan and not [x for x in exchanges(found) if "SortMergeJoin" in x]


def test_twins_meet_without_vectors(spark):
    items, _ = vectors(spark, 12)
    rated = spark.createDataFrame([(u, a, (u + a) % 11, a % 5) for u in range(3) for a in range(12)], "user_id long, appid long, rating int, fold int").join(items, "appid")
    sets = spark.createDataFrame([(a, a % 4) for a in range(12)], "appid long, set_id long")
    found = taste.strict_fold_features(rated, 5, [("vec", 1.0)], sets=sets)
    assert "_seed" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3 * 12 * 5


def test_solved_rows_are_stored_without_vectors(spark, monkeypatch):
    from curatrix.plans import solve
    held, keep = [], solve.checkpointed
    monkeypatch.setattr(solve, "checkpointed", lambda df: held.append(df.columns) or keep(df))
    items, _ = vectors(spark, 12)
    items = items.withColumns({"size": F.col("appid").cast("double"), "pop_z": F.lit(0.0)})
    rated = spark.createDataFrame([(u, a, (u * a) % 11) for u in range(3) for a in range(12)], "user_id long, appid long, rating int")
    grid = spark.createDataFrame([(s, a, float((a * (s + 2)) % 5)) for s in range(2) for a in range(12)], "step int, appid long, q double")
    out = solve.solve(rated, items, grid, features=("quality", "size"), parts=[("vec", 1.0)], discounted=None, powers=(1.0, 2.0))
    assert "vec" in out["known"].columns and out["known"].count() == 36
    assert held and not [c for c in held if "vec" in c]

@pytest.mark.parametrize("run", [1, 5, 64])
@pytest.mark.parametrize("signed", [False, True])
def test_products_of_short_lists_equal_sums(monkeypatch, run, signed):
    monkeypatch.setattr(pairs, "RUN_ROWS", run)
    rng = np.random.default_rng(4)
    w = rng.normal(size=(9, 6)) if signed else rng.random((9, 6))
    owner = np.array([0, 0, 0, 2, 3, 3, 3, 3, 3, 3, 5])
    gaps, at = rng.normal(size=len(owner)), rng.integers(0, 9, len(owner))
    gaps[3] = np.nan  # spoils its own user only
    num, den = np.zeros((2, 6, 6))
    pairs._add_products(owner, gaps, at, w, signed, num, den)
    want_num, want_den = np.zeros((2, 6, 6))
    np.add.at(want_num, owner, gaps[:, None] * w[at])
    np.add.at(want_den, owner, np.abs(w[at]))
    assert num == pytest.approx(want_num, nan_ok=True) and den == pytest.approx(want_den)
    assert np.isnan(num[2]).all() and np.isfinite(num[[0, 1, 3, 4, 5]]).all()
