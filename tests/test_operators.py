"""Literal cases and invariants of operators; brute force where SQL is no use."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import aggregates, bayes, explain, filters, kernel, matrix, normalize, pairs, playtime, regression, tags, taste, toplists
from curatrix.operators import joins
from curatrix.sources import readers


def values(df, key, column):
    return [r[column] for r in df.orderBy(key).collect()]


def numbers(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "appid long, x double")


@pytest.mark.parametrize(("xs", "zeros", "z"), [
    ([100, 0, 0, 0, 0], False, [2, -.5, -.5, -.5, -.5]), ([10, 10, 10, 0, 0, 0], True, [0, 0, 0, -10, -10, -10]), ([10, 20, 0, 0], True, [-1, 1, -3, -3]), ([1, 1, 1], False, [0, 0, 0])])
def test_to_z(spark, xs, zeros, z):
    assert values(normalize.to_z(numbers(spark, xs), {"x": "z"}, ignore_zeros=zeros), "appid", "z") == pytest.approx(z)


def test_date_z_clamps_and_keeps_unknown_at_zero(spark):
    days = [dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2030, 1, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "appid long, parsed_date timestamp")
    z = values(normalize.date_z(df, dt.date(2024, 1, 1)), "appid", "date_z")
    assert z[1] == z[2] and z[3] == 0 and z[0] < z[1]


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_value_ranks_do_not_depend_on_the_cut(spark, pieces):
    xs = [5, 1, 1, 2, 9, 9, 9, 3, 4, 1]
    got = {r["x"]: r["rank_avg"] for r in normalize.value_ranks(numbers(spark, xs), "x", pieces=pieces).collect()}
    order = sorted(xs)
    assert got == {x: np.mean([i + 1 for i, y in enumerate(order) if y == x]) for x in set(xs)}


def test_rank_normal(spark):
    df = numbers(spark, [1, 2, 3, 4, 5]).withColumn("feature", F.lit("f"))
    z = values(normalize.rank_normal(df, "x", ["feature"]), "appid", "z")
    assert z == sorted(z) and np.mean(z) == pytest.approx(0, abs=1e-9)


def test_top_k_splits_a_hot_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("appid"), (F.col("id") % 100).alias("v"))
    rows = toplists.top_k_by_group(df, ["g"], [F.desc("v"), F.asc("appid")], 3).orderBy("rank").collect()
    assert [r["appid"] for r in rows] == [99, 199, 299]


def test_information_criterion():
    assert regression.information(100, 10, 2, "bic") == pytest.approx(2 * np.log(100) + 100 * np.log(.1))


def test_pairwise_is_the_same_in_one_tile_or_many(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 5)))], "appid long, vec array<double>")
    a, b = (sorted(map(tuple, pairs.neighbours(df, df, 4, rows=limit).select("seed", "appid", "rank").collect())) for limit in (1000, 7))
    assert a == b and len(a) == 240


def test_users_with_long_lists_get_the_same_top(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 4)))], "appid long, vec array<double>")
    rated = spark.createDataFrame([(u, int(i), float(rng.integers(1, 10))) for u in range(4) for i in rng.choice(40, 3 + 5 * u, replace=False)], "user_id long, appid long, rating double")
    found = []
    for limit in (2048, 6):
        monkeypatch.setattr(pairs, "USER_ROWS", limit)
        found.append(sorted((r.user_id, r["rank"], r.appid, round(r.x_graph, 9)) for r in kernel.graph_feature(items, rated, k=5).collect()))
    assert found[0] == found[1] and len(found[0]) == 20
    full = kernel.graph_feature(items, rated).collect()
    best = {u: sorted([(-round(r.x_graph, 9), r.appid) for r in full if r.user_id == u])[:5] for u in range(4)}
    assert {u: [(x, a) for v, _, a, x in found[0] if v == u] for u in best} == {u: [(-x, a) for x, a in rows] for u, rows in best.items()}


def test_diverse_seeds_match_the_greedy_rule(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, int(100 - i), [float(x) for x in v]) for i, v in enumerate(m)], "appid long, n long, vec array<double>")
    chosen = []
    for i, v in enumerate(m):
        if len(chosen) < 5 and all(v @ m[j] / (np.linalg.norm(v) * np.linalg.norm(m[j]) + .5) < .1 for j in chosen):
            chosen.append(i)
    assert values(pairs.diverse_seeds(df, 5), "rank", "appid") == chosen


def test_whitening_gives_unit_second_moment(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "appid long, vec array<double>")
    white = np.array(values(matrix.whiten(df, "vec", 6), "appid", "white"))
    assert white.T @ white / len(white) == pytest.approx(np.eye(white.shape[1]), abs=1e-3)


def test_whitening_of_a_singular_table(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(100, 10))
    m -= m.mean(axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "appid long, vec array<double>")
    white = np.array(values(matrix.whiten(df, "vec", 10), "appid", "white"))
    assert 1 <= white.shape[1] <= 10 and np.abs(white).max() < 10


def synthetic_votes(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(rng.gamma(1, 1, (60, 4)) @ rng.gamma(1, 2, (4, 30))) * (rng.random((60, 30)) < .9)
    counts[:10] += 200
    rows = [(i, f"t{j:02d}", int(c)) for i, row in enumerate(counts) for j, c in enumerate(row) if c > 0]
    return spark.createDataFrame(rows, "appid long, tag string, votes long")


def test_imputation_keeps_shown_counts_and_the_cap(spark):
    votes = synthetic_votes(spark)
    names = tags.tag_list(votes)
    rows, mean = tags.impute(votes, names, rounds=2)
    raw = {r["appid"]: np.array(r["counts"]) for r in tags.dense(votes, names).collect()}
    assert mean.sum() == pytest.approx(1, abs=1e-5)
    for r in rows.collect():
        seen, new, old = np.array(r["seen"]) > 0, np.array(r["counts"]), raw[r["appid"]]
        assert new[seen] == pytest.approx(old[seen])
        if seen.sum() >= 20:
            assert (new[~seen] >= 0).all() and (new[~seen] <= np.sort(old[seen])[0] + 1e-9).all()
        else:
            assert new == pytest.approx(old)
    strength = tags.smoothing_strength(rows, mean, points=11)
    assert 0 < strength < 10000


def test_hidden_counts_equal_one_solve_an_item():
    rng = np.random.default_rng(2)
    x = rng.dirichlet(np.ones(8), 200)
    mean, cov = x.mean(axis=0), np.cov(x.T)
    counts, seen = rng.integers(0, 40, (30, 8)).astype(float), rng.random((30, 8)) < 0.6
    counts[0], seen[1], seen[2] = 0, True, False
    got = tags._expect(mean, cov, 3, counts, seen)
    for row, marks, out in zip(counts, seen, got):
        a, b = np.flatnonzero(marks), np.flatnonzero(~marks)
        want = row.copy()
        if len(a) >= 3 and len(b) and row.sum() > 0:
            shares = row[a] / row.sum()
            pull = np.linalg.inv(cov[np.ix_(a, a)] + tags.RIDGE * np.eye(len(a))) @ (shares - mean[a])
            want[b] = np.clip((mean[b] + cov[np.ix_(b, a)] @ pull) * row[a].sum() / shares.sum(), 0, np.sort(row[a])[-3])
        assert out == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("kind", ["clr", "anscombe", "none"])
def test_no_votes_give_the_zero_vector(spark, kind):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "appid long, counts array<double>")
    g = [.5, .3, .2]
    vec = tags.transform_profiles(tags.smoothed_profiles(df, g), g, kind, 100.0).first()["vec"]
    assert vec == pytest.approx([0, 0, 0], abs=1e-12)


def test_diffusion_has_unit_diagonal():
    a = np.array([[1, .5, 0], [.5, 1, .2], [0, .2, 1]])
    h = tags.diffuse(a)
    assert np.diag(h) == pytest.approx([1, 1, 1]) and h == pytest.approx(h.T) and h[0, 2] > 0
    best, scores = tags.diffusion_time(np.abs(np.random.default_rng(0).normal(size=(12, 12))) @ np.ones((12, 12)) / 20, [.5, 2.0], folds=3)
    assert best in (.5, 2.0) and len(scores) == 2


def reviews(spark):
    rows = [(1, 100, True), (1, 200, True), (1, 150, True), (2, 1000, True), (2, 50, False)]
    return spark.createDataFrame([(a, float(p), u) for a, p, u in rows], "appid long, playtime double, voted_up boolean")


def test_playtime_strength_is_positive_and_defaults(spark):
    ups = playtime.vote_histogram(reviews(spark).filter("voted_up"))
    assert playtime.playtime_strength(ups, least=1, points=9) > 0
    assert playtime.playtime_strength(ups, least=10**6) == 100.0


def test_leave_one_out_against_brute_force_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, up = rng.integers(1, 40, 300).astype(float), rng.random(300) < .7
    df = spark.createDataFrame([(int(i % 3), float(a), bool(b)) for i, (a, b) in enumerate(zip(x, up))], "appid long, playtime double, voted_up boolean")
    monkeypatch.setattr(playtime, "CHUNK", 5)
    got = {(r["appid"], r["x"], r["voted_up"]): r["p_plus"] for r in playtime.leave_one_out(playtime.vote_histogram(df), F.lit(.8), .7, 1.5).collect()}
    for i in range(300):
        same = (np.arange(300) % 3 == i % 3) & (np.arange(300) != i)
        w = np.exp(-.5 * ((np.log(x[same] + 1e-9) - np.log(x[i] + 1e-9)) / .7) ** 2)
        assert got[(i % 3, x[i], bool(up[i]))] == pytest.approx(((w * up[same]).sum() + 1.5 * .8) / (w.sum() + 1.5))


def rated(spark, users=2, items=30):
    rng = np.random.default_rng(7)
    rows = [(u, i, int(rng.integers(0, 11)), float(rng.normal()), [float(v) for v in rng.normal(size=4)], int(i % 5)) for u in range(users) for i in range(items)]
    return spark.createDataFrame(rows, "user_id long, appid long, rating int, x double, vec array<double>, fold int"), rows


def test_power_errors_do_not_depend_on_chunks(spark):
    df, _ = rated(spark)
    df = df.withColumn("residual", F.col("rating") - 5.0)
    def run():
        return sorted((r["user_id"], r["power"], round(r["mse"], 9)) for r in taste.power_errors(df, [1.0, 3.0], [("vec", 1.0)], None).collect())
    whole = run()
    original = taste.within_user_blocks.__defaults__
    taste.within_user_blocks.__defaults__ = (7,)
    try:
        assert run() == whole
    finally:
        taste.within_user_blocks.__defaults__ = original


def test_refit_matches_brute_force(spark):
    df, rows = rated(spark, users=1, items=20)
    got = {r["appid"]: r["predicted"] for r in taste.loo_refit(df, ["x"], [("vec", 1.0)], 2.0, 1.0).collect()}
    x, y, v = np.array([r[3] for r in rows]), np.array([r[2] for r in rows], float), np.array([r[4] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    for i in range(20):
        k = np.arange(20) != i
        b = ((x[k] - x[k].mean()) @ (y[k] - y[k].mean())) / (((x[k] - x[k].mean()) ** 2).sum() + 1.0)
        a = y[k].mean() - b * x[k].mean()
        w = np.sign(s[i, k]) * s[i, k] ** 2
        assert got[i] == pytest.approx(np.clip(a + b * x[i] + (w @ (y[k] - a - b * x[k])) / np.abs(w).sum(), 0, 10))


def test_strict_features_never_see_the_held_out_fold(spark):
    df, rows = rated(spark, users=1, items=20)
    got = {(r["appid"], r["held_out"]): r["x_rated"] for r in taste.strict_fold_features(df, 5, [("vec", 1.0)], 2.0).collect()}
    y, v, fold = np.array([r[2] for r in rows], float), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(20):
        for f in range(5):
            k = (np.arange(20) != i) & (fold != f)
            w = np.exp(2.0 * (v[i] @ v[k].T))
            assert got[(i, f)] == pytest.approx((w @ (y[k] - 5)) / (w.sum() + 1e-9))
    table = taste.strict_cross_validation(df, taste.strict_fold_features(df, 5, [("vec", 1.0)]), ["x"], [1.0])
    assert np.isfinite(table["r2"]).all()


def test_ridge_and_lasso_from_products(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) * [1, 5, 1] + [0, 3, 0]
    y = 1 + 2 * x[:, 0] - x[:, 1] * .4 + rng.normal(size=200) * .1
    df = spark.createDataFrame([(int(i), *[float(a) for a in r], float(b)) for i, (r, b) in enumerate(zip(x, y))], "appid long, a double, b double, c double, y double")
    p = regression.products(df, ["a", "b", "c"], "y", regression.fold_of(F.col("appid")), 5)
    z = (x - x.mean(0)) / x.std(0)
    expect = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert regression.fit(p.total, [0, 1, 2], 3.0).beta == pytest.approx(expect)
    sparse = regression.fit(p.total, [0, 1, 2], 0.3, 1.0)
    assert abs(sparse.beta[2]) < 1e-9 and sparse.beta[0] > 1
    assert list(regression.stepwise(p)["feature"]) == ["a", "b"] or list(regression.stepwise(p)["feature"]) == ["b", "a"]
    assert regression.cross_validate(p, ["a", "b", "c"], [0.1])["r2"].iloc[0] > .9
    zero = regression.zero_sum_fit(p.total, [0, 1, 2])
    assert zero.beta.sum() == pytest.approx(0)


def test_forward_selection_keeps_what_helps(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i, float(q), float(a), float(n), float(3 + q + 2 * a + rng.normal() * .1)) for i, (q, a, n) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "user_id long, appid long, quality double, age double, noise double, rating double")
    model = regression.user_models(df, ["quality", "age", "noise"], "rating", first="quality").first()
    assert model["features"][:2] == ["quality", "age"] and model["beta"][:2] == pytest.approx([1, 2], abs=.1)


def test_tag_effect_p_values(spark):
    t = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-4.5, 30.0), (1.0, 2.5)], "t double, df double")
    got = [r["p"] for r in t.select(aggregates.two_sided_p("t", "df").alias("p")).collect()]

    def by_integration(x, n):
        grid = np.linspace(0, abs(x), 200_001)
        density = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / np.sqrt(n * np.pi) * (1 + grid**2 / n) ** (-(n + 1) / 2)
        return 1 - 2 * np.trapezoid(density, grid)

    assert got == pytest.approx([by_integration(2, 10), 1.0, by_integration(-4.5, 30), by_integration(1, 2.5)], abs=1e-9)


def test_penalty_needs_enough_rows(spark):
    many = spark.createDataFrame([(.5 + .2 * i,) for i in range(20)], "norm double")
    assert aggregates.similarity_penalty(many).first()["penalty"] > 3.5
    assert aggregates.similarity_penalty(spark.createDataFrame([(10.0,), (20.0,)], "norm double")).first()["penalty"] == 1.0


def test_grid_step():
    assert [bayes.grid_step(v) for v in (-1, 0, 1, 5, -9)] == [0, 10, 20, 20, 0]


def test_preclean_drops_nameless_and_duplicates(spark):
    rows = [(10, "Game 1", "{'Action': 10}", False, 0), (10, "Again", "{}", False, 1), (20, None, "{}", False, 0), (30, "DLC", "{}", True, 0), (40, "Game 4", None, False, 0)]
    df = spark.createDataFrame(rows, "appid long, name string, tags string, is_dlc boolean, seq int")
    out = filters.preclean(df, ["seq"])
    assert sorted((r["appid"], r["name"], r["tags"]) for r in out.collect()) == [(10, "Game 1", "{'Action': 10}"), (40, "Game 4", "{}")]


def test_all_empty_languages_count_as_english(spark):
    df = spark.createDataFrame([(1, "n", "", "", "", "{}", "", "", 0)], "appid long, name string, categories string, languages string, price string, tags string, genres string, short_description string, mature_content int")
    row = filters.with_flags(df).first()
    assert row["is_english"] and row["is_hollow"] and not row["is_nsfw"]


def test_interpolation_is_flat_beyond_the_curve(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (3.0, 30.0)], "cx double, cy double")
    xs = numbers(spark, [-1, 0, .5, 2, 3, 9])
    for pieces in (1, 2, 64):
        assert values(joins.interpolate(xs, "x", curve, "y", pieces), "appid", "y") == pytest.approx([0, 0, 5, 20, 30, 30])


def test_page_folder(spark, tmp_path):
    (tmp_path / "12_page.html").write_text("<p>\nhello</p>")
    (tmp_path / "7_page.html").write_text("<p>bye</p>")
    rows = readers.read_page_folder(spark, str(tmp_path), "(\\d+)_page").orderBy("appid").collect()
    assert [(r["appid"], r["html"]) for r in rows] == [(7, "<p>bye</p>"), (12, "<p>\nhello</p>")]


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"appid","review_id","review_text"\n"1","x","line\nbreak ""quoted"", comma"\n', encoding="utf-8")
    row = readers.read_csv(spark, str(tmp_path), "appid LONG, review_id STRING, review_text STRING").first()
    assert (row["appid"], row["review_text"]) == (1, 'line\nbreak "quoted", comma')


def test_word_pairs_and_bags_look_at_all_words(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(40, 3))
    names = [f"w{i:02d}" for i in range(40)]
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, m)], "word string, vec array<double>")
    for sign, difference in ((-1.0, True), (1.0, False)):
        got = {r.dim: (r.first, r.second) for r in explain.label_pairs(df, difference).collect()}
        for d in range(3):
            best = max(((m[i, d] + sign * m[j, d]) / np.linalg.norm(m[i] + sign * m[j]), -i, -j) for i in range(40) for j in range(40) if i != j)
            want = (names[-best[1]], names[-best[2]])
            assert got[d] == (min(want), max(want)) if not difference else got[d] == want
    bags = {r.dim: r.words for r in explain.label_dimensions(df, 3, 2).collect()}
    for d in range(3):
        first = int(np.argmax(m[:, d] / np.linalg.norm(m, axis=1)))
        value = (m[first, d] + m[:, d]) / np.linalg.norm(m[first] + m, axis=1)
        value[first] = -np.inf
        more = int(np.argmax(value))
        assert bags[d] == [names[first], names[more]][: 1 + (value[more] > m[first, d] / np.linalg.norm(m[first]))]
