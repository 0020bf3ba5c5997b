"""Regression, taste models and recommendation."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from curatrix.checks.ranking import GRID_SQL, counted, grid
from curatrix.checks.registry import check
from curatrix.checks.scalars import FLAGS_SQL, busiest_user, flagged
from curatrix.checks.similarity import FEATURES_SQL, SEED_KERNEL_SQL, features, taxonomy
from curatrix.functions import normal
from curatrix.operators import aggregates, bayes, factors, joins, kernel, regression, tags, taste, toplists
from curatrix.operators.normalize import r6, to_z
from curatrix.plans import difficulty
from curatrix.plans import recommend as R
from curatrix.plans import solve as S
from curatrix.session import checkpointed

# ----------------------------------------------------------------------------- one model over all items

NUM_SQL = """
, num AS (SELECT appid, name, CAST(n AS DOUBLE) AS y, CAST(size AS DOUBLE) AS x1, price AS x2 FROM catalogue),
mo AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM num),
be AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM mo),
ft AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS rss FROM be)"""


def numeric(t):
    return t.catalogue.select("appid", "name", F.col("n").cast("double").alias("y"), F.col("size").cast("double").alias("x1"), F.col("price").alias("x2"))


def named(spark, frame):
    return spark.createDataFrame(frame)


@check("least_squares_aicc", NUM_SQL + """
SELECT round(b0, 6) AS intercept, round(b1, 6) + 0e0 AS b1, round(b2, 6) + 0e0 AS b2, round(rss, 4) AS rss, round(n * ln(rss / n) + 2 * 3 + 2.0 * 3 * 4 / (n - 4), 5) AS aicc FROM ft""")
def _(t):
    p = regression.products(numeric(t), ["x1", "x2"], "y")
    m = p.total
    model = regression.fit(m, [0, 1])
    error = regression.rss(m, model)
    row = t.spark.createDataFrame([(model.intercept, float(model.beta[0]), float(model.beta[1]), error, regression.information(m[0, 0], error, 3, "aicc"))],
                                  "intercept double, b1 double, b2 double, rss double, aicc double")
    return row.select(r6("intercept"), r6("b1"), r6("b2"), r6("rss", 4), r6("aicc", 5))


@check("leverage_and_cook", NUM_SQL + """
, r AS (SELECT appid, y - b0 - b1 * x1 - b2 * x2 AS e, (s22 * power(x1 - m1, 2) - 2 * s12 * (x1 - m1) * (x2 - m2) + s11 * power(x2 - m2, 2)) / (n * (s11 * s22 - s12 * s12)) AS h, rss / (n - 2) AS mse, n FROM num, ft)
SELECT appid, round(e, 5) + 0e0 AS residual, round(h, 7) AS leverage, round(e * e / (2 * mse) * h / power(1 - h, 2), 7) AS cooks_d, h > 6.0 / n AS high_leverage, e * e / (2 * mse) * h / power(1 - h, 2) > 4.0 / n AS influential FROM r""")
def _(t):
    rows = numeric(t)
    out = regression.influence(rows, regression.products(rows, ["x1", "x2"], "y"), "y")
    return out.select("appid", r6("residual", 5), r6("leverage", 7), r6("cooks_d", 7), "high_leverage", "influential")


@check("error_report", NUM_SQL + """
, r AS (SELECT appid, y - b0 - b1 * x1 - b2 * x2 AS e FROM num, ft)
SELECT * FROM (SELECT 'under' AS side, appid, round(e, 5) AS error FROM r ORDER BY e DESC, appid LIMIT 30) UNION ALL SELECT * FROM (SELECT 'over', appid, round(e, 5) FROM r ORDER BY e, appid LIMIT 30)""")
def _(t):
    return errors(t).select("side", "appid", r6("error", 5))


def errors(t):
    rows = numeric(t)
    p = regression.products(rows, ["x1", "x2"], "y")
    return regression.error_report(regression.predict(rows, p, regression.fit(p.total, [0, 1])), "y", "predicted")


@check("error_tag_patterns", NUM_SQL + """
, r AS (SELECT appid, y - b0 - b1 * x1 - b2 * x2 AS e FROM num, ft), w AS (SELECT * FROM (SELECT 'under' AS side, appid FROM r ORDER BY e DESC, appid LIMIT 30) UNION ALL SELECT * FROM (SELECT 'over', appid FROM r ORDER BY e, appid LIMIT 30))
SELECT side, tag, count(*) AS n FROM w JOIN votes v ON w.appid = v.appid GROUP BY 1, 2""")
def _(t):
    return regression.error_tags(errors(t), t.votes)


@check("zero_sum_coefficients", NUM_SQL + """
, z AS (SELECT (s2y - s1y) / (s22 - 2 * s12 + s11) AS b FROM mo) SELECT round(-b, 7) + 0e0 AS b1, round(b, 7) + 0e0 AS b2, round(my - (-b) * m1 - b * m2, 6) AS intercept FROM z, mo""")
def _(t):
    model = regression.zero_sum_fit(regression.products(numeric(t), ["x1", "x2"], "y").total, [0, 1])
    return t.spark.createDataFrame([(float(model.beta[0]), float(model.beta[1]), model.intercept)], "b1 double, b2 double, intercept double").select(r6("b1", 7), r6("b2", 7), r6("intercept"))


@check("feature_contributions", """
, co AS (SELECT n_name AS feature, (n_nationkey - 12) / 10.0::DOUBLE AS c FROM nation), s AS (SELECT appid, sum(votes * c) AS total FROM votes JOIN co ON tag = feature GROUP BY 1),
r AS (SELECT appid, tag AS feature, votes * c AS contribution, row_number() OVER (PARTITION BY appid ORDER BY abs(votes * c) DESC, tag) AS rank FROM votes JOIN co ON tag = feature)
SELECT r.appid, feature, round(contribution, 6) + 0e0 AS contribution, CAST(rank AS INTEGER) AS rank, round(total, 6) + 0e0 AS total FROM r JOIN s ON r.appid = s.appid WHERE rank <= 10""")
def _(t):
    co = t.table("nation").select(F.col("n_name").alias("feature"), ((F.col("n_nationkey") - 12) / 10.0).alias("coefficient"))
    rows = regression.contributions(t.votes.select("appid", F.col("tag").alias("feature"), F.col("votes").cast("double").alias("value")), co)
    total = rows.groupBy("appid").agg(F.sum("contribution").alias("total"))
    top = toplists.top_k_by_group(rows, ["appid"], [F.desc(F.abs("contribution")), F.asc("feature")], 10)
    return top.join(total, "appid").select("appid", "feature", r6("contribution"), "rank", r6("total"))


@check("composite_target", """
, v AS (SELECT i.appid, coalesce(max(votes) FILTER (tag = 'NATION_1'), 0) AS a, coalesce(max(votes) FILTER (tag = 'NATION_2'), 0) AS b FROM items i LEFT JOIN votes o ON i.appid = o.appid GROUP BY 1),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM v) SELECT appid, round((a - ma) / CASE WHEN sa > 1e-9 THEN sa ELSE 1 END + (b - mb) / CASE WHEN sb > 1e-9 THEN sb ELSE 1 END, 6) + 0e0 AS target FROM v, s""")
def _(t):
    two = t.votes.filter(F.col("tag").isin("NATION_1", "NATION_2")).groupBy("appid").pivot("tag", ["NATION_1", "NATION_2"]).agg(F.max("votes"))
    z = to_z(t.items.select("appid").join(two, "appid", "left").na.fill(0), {"NATION_1": "a", "NATION_2": "b"})
    return z.withColumn("target", F.col("a") + F.col("b")).select("appid", r6("target"))


def tag_products(t, folds=5):
    names = tags.tag_list(t.votes)
    rows = tags.dense(t.votes, names).join(t.review_stats.select("appid", (F.col("positive") / F.col("n")).alias("y")), "appid")
    cols = rows.select("appid", "y", *[F.col("counts")[i].alias(n) for i, n in enumerate(names)])
    return cols, regression.products(cols, names, "y", regression.fold_of(F.col("appid"), folds), folds)


@check("relevant_features", """
, d AS (SELECT s.appid, o.tag AS feature, CAST(coalesce(votes, 0) AS DOUBLE) AS x, positive / CAST(n AS DOUBLE) AS y FROM review_stats s CROSS JOIN tag_names o LEFT JOIN votes v ON v.appid = s.appid AND v.tag = o.tag),
r AS (SELECT feature, corr(x, y) AS r FROM d GROUP BY 1) SELECT feature, round(r, 6) + 0e0 AS r FROM r ORDER BY abs(r.r) DESC, feature LIMIT (SELECT count(*) - 6 FROM tag_names)""")
def _(t):
    _, p = tag_products(t)
    keep = regression.relevant_features(p, len(p.features) - 6)
    return t.spark.createDataFrame(regression.target_correlations(p)).filter(F.col("feature").isin(keep)).select("feature", r6("r"))


@check("stepwise_selection")
def _(t):
    _, p = tag_products(t)
    frames = [regression.stepwise(p, c).assign(criterion=c) for c in ("aic", "bic")]
    rows = [tuple(r) for f in frames for r in f[["criterion", "step", "move", "feature", "value", "k"]].itertuples(index=False)]
    return t.spark.createDataFrame(rows, "criterion string, step long, move string, feature string, value double, k long")


@check("ridge_alpha_search")
def _(t):
    _, p = tag_products(t)
    return named(t.spark, regression.cross_validate(p, p.features, [0.1, 1.0, 10.0, 100.0, 1000.0]))


@check("model_comparison")
def _(t):
    _, p = tag_products(t)
    out = []
    for name, ratio in (("ridge", 0.0), ("elastic_net", 0.5), ("lasso", 1.0)):
        grid_ = [1.0, 10.0, 100.0] if ratio == 0 else [1e-4, 1e-3, 1e-2]
        train, test = p.split(0)
        model = regression.fit(train, p.index(p.features), regression.best_alpha(p, p.features, grid_, ratio), ratio)
        for part, m in (("train", train), ("test", test)):
            out.append((name, part, *[regression.scores(m, model)[k] for k in ("r2", "mse", "rmse", "nonzero")]))
    return t.spark.createDataFrame(out, "model string, part string, r2 double, mse double, rmse double, nonzero double")


def difficulty_inputs(t):
    """Tag profiles (CLR) with topics, and labels whose titles match: every third item has a rating that follows its size and one tag."""
    t.keep("votes")
    names = tags.tag_list(t.votes)
    prior = {r["tag"]: r["share"] for r in aggregates.tag_prior(t.votes).collect()}
    g = [prior[n] for n in names]
    clr = tags.transform_profiles(tags.smoothed_profiles(tags.dense(t.votes, names), g, 8.0), g, "clr").select("appid", "vec")
    rows = clr.join(features(t).select("appid", "topics"), "appid").select("appid", F.concat("vec", "topics").alias("vec"))
    listed = t.items.join(t.votes.filter("tag = 'NATION_1'").select("appid", "votes"), "appid", "left").filter("appid % 3 = 0")
    rated = listed.select(F.concat(F.lit("The "), "title", F.lit(": Remastered")).alias("title"), (1 + F.least(F.lit(4.0), F.coalesce("votes", F.lit(0)) * 2 + F.col("size") / 50)).alias("difficulty"))
    topics = [f"topic_{i}" for i in range(10)]
    return rows, difficulty.labels(rated, t.items.select("appid", F.col("title").alias("name"))), [*names, *topics]


@check("difficulty_model")
def _(t):
    return difficulty.difficulty_model(*difficulty_inputs(t))[0]


@check("difficulty_coefficients")
def _(t):
    return difficulty.difficulty_model(*difficulty_inputs(t))[1]


def rated_features(t):
    """Rated rows of the busiest user with metadata, topics and the two rating-derived features."""
    mine = busiest_user(t).select("user_id", "appid", F.col("rating").cast("double").alias("rating"))
    rows = mine.join(t.catalogue.select("appid", F.col("n").cast("double").alias("popularity"), F.col("size").cast("double").alias("size"), "price"), "appid")
    items = features(t)
    topics = items.select("appid", *[F.col("topics")[i].alias(f"topic_{i}") for i in range(1, 10)])
    derived = kernel.rating_feature(items, mine, taxonomy(t)).join(kernel.graph_feature(t.vectors, mine), ["user_id", "appid"])
    return rows.join(topics, "appid").join(derived, ["user_id", "appid"])


@check("feature_set_comparison")
def _(t):
    meta, topics = ["popularity", "size", "price"], [f"topic_{i}" for i in range(1, 10)]
    p = regression.products(rated_features(t), [*meta, *topics, "x_kernel", "x_graph"], "rating", regression.fold_of(F.col("appid")), 5)
    sets = {"metadata": meta, "with kernel": [*meta, "x_kernel"], "with graph": [*meta, "x_graph"], "with topics": [*meta, *topics], "all": p.features}
    return named(t.spark, regression.compare_sets(p, sets, [1.0, 10.0, 100.0, 1000.0]))


@check("learning_curve")
def _(t):
    names = tags.tag_list(t.votes)
    rows = tags.dense(t.votes, names).join(t.review_stats.select("appid", (F.col("positive") / F.col("n")).alias("y")), "appid")
    cols = rows.select("appid", "y", *[F.col("counts")[i].alias(n) for i, n in enumerate(names)])
    return named(t.spark, regression.learning_grid(cols, names, "y", F.col("appid"), [0.2, 0.5, 1.0], [1, 2, 5, 10, 25], [1.0, 10.0, 100.0]))


@check("supervised_pca")
def _(t):
    _, p = tag_products(t)
    return named(t.spark, regression.supervised_pca(p, [0.0, 0.01, 0.02, 0.03]))


@check("rbf_basis_against_linear")
def _(t):
    rows = to_z(numeric(t), {"x1": "z"})
    basis = regression.rbf_columns(F.col("z"), np.linspace(-2.5, 2.5, 11))
    wide = rows.withColumns(basis)
    p = regression.products(wide, ["z", *basis], "y", regression.fold_of(F.col("appid")), 5)
    return named(t.spark, regression.compare_sets(p, {"linear": ["z"], "rbf": list(basis)}, [0.1, 1.0, 10.0]))


@check("neutral_anchor_model", NUM_SQL + """
, w AS (SELECT y, x1 FROM num UNION ALL SELECT 5.0, 0.0) SELECT round(regr_slope(y, x1), 6) + 0e0 AS slope, round(regr_intercept(y, x1), 6) AS intercept FROM w""")
def _(t):
    rows = regression.with_neutral_row(numeric(t).select("y", "x1"), ["x1"], "y")
    model = regression.fit(regression.products(rows, ["x1"], "y").total, [0])
    return t.spark.createDataFrame([(float(model.beta[0]), model.intercept)], "slope double, intercept double").select(r6("slope"), r6("intercept"))


@check("tag_factor_loadings")
def _(t):
    names = tags.tag_list(t.votes)
    return factors.factor_loadings(tags.dense(t.votes, names), "counts", names, 5)


# ----------------------------------------------------------------------------- users


@check("best_discovery_step", GRID_SQL + """
, c AS (SELECT user_id, step, CASE WHEN stddev_pop(q) > 1e-12 AND stddev_pop(rating) > 0 THEN corr(q, rating) END AS r FROM ratings r JOIN grid g ON r.appid = g.appid GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(r, 12) DESC NULLS LAST, step) AS rn FROM c) SELECT user_id, round(r, 6) + 0e0 AS r FROM w WHERE rn = 1""")
def _(t):
    return taste.best_step(t.ratings, grid(t)).select("user_id", r6("r"))


USER_SQL = """
, ur AS (SELECT r.user_id, r.appid, CAST(rating AS DOUBLE) AS y, CAST(c.n AS DOUBLE) AS x, v.vec FROM ratings r JOIN catalogue c ON r.appid = c.appid JOIN vectors v ON v.appid = r.appid),
ub AS (SELECT user_id, count(*) AS k, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) ELSE 0 END AS b, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) ELSE avg(y) END AS a FROM ur GROUP BY 1),
res AS (SELECT ur.*, y - a - b * x AS e FROM ur JOIN ub ON ur.user_id = ub.user_id)"""


def rated_vectors(t):
    rows = t.ratings.join(t.catalogue.select("appid", F.col("n").cast("double").alias("x")), "appid").join(t.vectors.select("appid", "vec"), "appid")
    models = regression.user_models(rows, ["x"], "rating")
    return models, regression.user_predictions(rows, models, ["x"]).withColumn("residual", F.col("rating") - F.col("base"))


@check("user_linear_models", USER_SQL + " SELECT user_id, k AS n, round(round(a, 12), 5) + 0e0 AS intercept, round(round(b, 12), 6) + 0e0 AS beta FROM ub WHERE k >= 5")
def _(t):
    models, _ = rated_vectors(t)
    exact = models.withColumns({"intercept": F.round("intercept", 12), "slope": F.round(F.col("beta")[0], 12)})
    return exact.filter("n >= 5").select("user_id", F.col("n").cast("long").alias("n"), r6("intercept", 5), (F.round("slope", 6) + 0.0).alias("beta"))


@check("forward_selected_models")
def _(t):
    rows = t.ratings.join(t.catalogue.select("appid", F.col("n").cast("double").alias("quality"), F.col("size").cast("double").alias("age"), "price"), "appid")
    return regression.user_models(rows, ["quality", "age", "price"], "rating", first="quality")


COS = "list_dot_product({a}.vec, {b}.vec) / (sqrt(list_dot_product({a}.vec, {a}.vec)) * sqrt(list_dot_product({b}.vec, {b}.vec)))"


@check("smoothing_power_errors", USER_SQL + f"""
, ps AS (SELECT a.user_id, a.appid, a.e, b.e AS be, {COS.format(a='a', b='b')} AS s FROM res a JOIN res b ON a.user_id = b.user_id AND a.appid <> b.appid), pw AS (SELECT unnest([1.0, 2.0, 4.0]::DOUBLE[]) AS power),
wr AS (SELECT user_id, appid, power, any_value(e) AS e, sum(sign(s) * power(abs(s), power) * be) / sum(power(abs(s), power)) AS p FROM ps, pw GROUP BY 1, 2, 3)
SELECT user_id, power, round(avg((e - p) * (e - p)), 5) AS mse, count(*) AS n FROM wr GROUP BY 1, 2""")
def _(t):
    _, rows = rated_vectors(t)
    return taste.power_errors(rows, [1.0, 2.0, 4.0], [("vec", 1.0)], None).select("user_id", "power", r6("mse", 5), "n")


@check("projected_top_lists", USER_SQL + f"""
, ps AS (SELECT r.user_id, c.appid, sum(CASE WHEN r.appid = c.appid THEN 0 ELSE sign(s) * s * s * e END) AS num, sum(CASE WHEN r.appid = c.appid THEN 0 ELSE s * s END) AS den
  FROM (SELECT r.user_id, r.appid, r.e, c.appid AS cid, {COS.format(a='c', b='r')} AS s FROM res r CROSS JOIN vectors c) r JOIN vectors c ON r.cid = c.appid GROUP BY 1, 2),
pr AS (SELECT ps.user_id, ps.appid, greatest(0, least(10, a + b * c.n + coalesce(num / nullif(den, 0), 0))) AS p FROM ps JOIN ub ON ps.user_id = ub.user_id JOIN catalogue c ON c.appid = ps.appid),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, appid) AS rank FROM pr) SELECT user_id, CAST(rank AS INTEGER) AS rank, round(p, 5) AS projected_rating FROM rk WHERE rank <= 10""")
def _(t):
    models, rows = rated_vectors(t)
    items = t.vectors.select("appid", "vec").join(t.catalogue.select("appid", F.col("n").cast("double").alias("x")), "appid")
    known = rows.withColumn("power", F.lit(2.0)).select("user_id", "appid", "residual", "power", "vec")
    top = taste.project_top(items, known, models, ["x"], 10, [("vec", 1.0)], None)
    return top.select("user_id", "rank", r6("projected_rating", 5))


@check("kernel_alternatives", USER_SQL + f"""
, mu AS (SELECT user_id, avg(y) AS m FROM ur GROUP BY 1), ps AS (SELECT a.user_id, a.appid, a.y, b.y AS z, {COS.format(a='a', b='b')} AS s FROM ur a JOIN ur b ON a.user_id = b.user_id AND a.appid <> b.appid),
f AS (SELECT user_id, appid, y, z, unnest([{{'form': 'power', 'w': power(greatest(s, 0), 2)}}, {{'form': 'exp', 'w': exp(5 * (s - 1))}}, {{'form': 'signed', 'w': sign(s) * s * s}}, {{'form': 'threshold', 'w': power(greatest(s - 0.1, 0), 2)}}]) AS f FROM ps),
p AS (SELECT f.user_id, f.appid, f.f.form AS form, any_value(y) AS y, any_value(m) + CASE WHEN sum(abs(f.f.w)) > 0 THEN sum(f.f.w * (z - m)) / nullif(sum(abs(f.f.w)), 0) ELSE 0 END AS p FROM f JOIN mu ON f.user_id = mu.user_id GROUP BY 1, 2, 3)
SELECT form, count(*) AS n, round(1 - sum(power(y - p, 2)) / (count(*) * var_pop(y)), 5) + 0e0 AS r2, round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg(power(y - p, 2))), 5) AS rmse FROM p GROUP BY 1""")
def _(t):
    rows = t.ratings.join(t.vectors.select("appid", "vec"), "appid")
    forms = {"power": ("power", 2.0), "exp": ("exp", 5.0), "signed": ("signed", 2.0), "threshold": ("threshold", 0.1)}
    many = rows.join(rows.groupBy("user_id").agg(F.count("*").alias("c")).filter("c > 1").select("user_id"), "user_id", "left_semi")
    out = regression.regression_scores(taste.loo_alternatives(many, forms, [("vec", 1.0)]), "rating", "predicted", ["form"])
    return out.select("form", "n", r6("r2", 5), r6("mae", 5), r6("rmse", 5))


@check("refitted_leave_one_out")
def _(t):
    rows = t.ratings.join(t.catalogue.select("appid", F.col("n").cast("double").alias("x")), "appid").join(t.vectors.select("appid", "vec"), "appid")
    return regression.regression_scores(taste.loo_refit(rows, ["x"], [("vec", 1.0)]), "rating", "predicted")


@check("strict_out_of_sample")
def _(t):
    """Ridge, lasso and elastic net over strict folds, twins of a series left out, beside the same with every rating known (the leaky contrast)."""
    vectors = t.vectors.select("appid", "vec")
    rows = checkpointed(t.ratings.join(t.catalogue.select("appid", F.col("n").cast("double").alias("x")), "appid").join(vectors.select("appid"), "appid", "left_semi")
                        .withColumn("fold", regression.fold_of(F.col("appid")))).join(vectors, "appid")  # stored without the vectors
    titles = t.items.select("appid", "name")
    sets, twins = joins.title_sets(titles), joins.series_twins(titles)
    strict = checkpointed(taste.strict_fold_features(rows, 5, [("vec", 1.0)], sets=sets, twins=twins, stored=True))
    found = [taste.strict_cross_validation(rows, strict, ["x"], alphas, l1_ratio=ratio).assign(model=name)
             for name, ratio, alphas in (("ridge", 0.0, [1.0, 10.0, 100.0]), ("lasso", 1.0, [0.001, 0.01, 0.1]), ("elastic net", 0.5, [0.001, 0.01, 0.1]))]
    leaky = checkpointed(taste.strict_fold_features(rows.withColumn("fold", F.lit(9)), 5, [("vec", 1.0)], stored=True))
    found.append(taste.strict_cross_validation(rows, leaky, ["x"], [10.0]).assign(model="leaky ridge"))
    return named(t.spark, pd.concat(found))


def solve_inputs(t):
    rows = features(t)
    items = rows.select("appid", "name", "vec", "verbs", "topics", "tag_set", F.col("difficulty_z").alias("difficulty"), F.col("tone_z").alias("tone"), F.col("price"),
                        F.col("positive").cast("double").alias("popularity"), F.col("n").cast("double").alias("length"), F.col("size").cast("double").alias("age"), F.col("tone_z").alias("pop_z"))
    return items.withColumns({"puzzle_class": kernel.puzzle_class(), "chance": kernel.subversion_chance()}), t.ratings.select("user_id", "appid", "rating")


PARTS = (("verbs", 0.174), ("vec", 0.593), ("topics", 0.233))


def solved(t):
    items, rated = solve_inputs(t)
    return items, rated, S.solve(rated, items, grid(t), parts=PARTS, discounted="topics")


@check("taste_profiles")
def _(t):
    return solved(t)[2]["profiles"]


def status():
    r = F.col("rating")
    return F.when(r >= 7, "rated").when(r >= 4, "played").when(r == 0, "wishlist").otherwise("backlog").alias("status")


@check("user_report")
def _(t):
    items, rated, out = solved(t)
    marks = t.catalogue.select("appid", (F.col("n") >= 10).alias("recommendable"), (F.col("price") < 920).alias("is_free"), (F.col("first_ts") > F.lit(dt.datetime(1993, 6, 1))).alias("is_upcoming"))
    effects = checkpointed(aggregates.significant_effects(aggregates.tag_effects(rated, t.votes)))
    truth = rated.select("user_id", "appid", status())
    found = S.lists(out, items.join(marks, "appid"), grid(t), truth, effects, parts=PARTS, discounted="topics")
    return S.report(found, effects)


@check("interactive_pool", FLAGS_SQL + """
, me AS (SELECT user_id FROM ratings GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1),
st AS (SELECT appid, CASE WHEN rating >= 7 THEN 'rated' WHEN rating >= 4 THEN 'played' WHEN rating = 0 THEN 'wishlist' ELSE 'backlog' END AS status FROM ratings WHERE user_id = (SELECT user_id FROM me))
SELECT c.appid, round(least(10, greatest(0, c.size / 5.0::DOUBLE)), 6) AS projected_rating, c.price, coalesce(status IN ('backlog', 'unplayed'), false) AS is_backlog, coalesce(status = 'wishlist', false) AS is_wishlist
FROM catalogue c JOIN flagged f ON f.appid = c.appid LEFT JOIN st ON st.appid = c.appid
WHERE c.n >= 30 AND c.positive / (c.n + 1e-9) >= 0.65 AND NOT is_hollow AND NOT is_delisted AND NOT is_utility AND NOT is_nsfw AND coalesce(status, '') NOT IN ('ignored', 'rated', 'played')""")
def _(t):
    mine = busiest_user(t)
    flags = flagged(t).select("appid", "is_hollow", "is_delisted", "is_utility", "is_nsfw")
    items = t.catalogue.join(flags, "appid").withColumn("tag_set", F.array().cast("array<string>"))
    projected = t.catalogue.withColumn("user_id", mine.agg(F.max("user_id").alias("x")).scalar()).select(
        "user_id", "appid", F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("size") / 5.0)).alias("projected_rating"))
    pool = S.interactive_pool(projected, items, mine.select("user_id", "appid", status()), ["price"], min_reviews=30)
    return pool.select("appid", r6("projected_rating"), "price", "is_backlog", "is_wishlist")


# ----------------------------------------------------------------------------- recommendation

LAST_SQL = ", lastv AS (SELECT vec AS pv FROM vectors ORDER BY appid DESC LIMIT 1)"


def recommend_items(t):
    """Every item with features; one that the catalogue left out counts as delisted, so only the kernel sees it."""
    stats = t.review_stats.join(features(t).select("appid"), "appid", "left_semi")  # a median of the items with features only
    base = features(t).join(flagged(t).drop("name", "tags", "price"), "appid", "left").join(t.items.select("appid").join(
        stats.select("appid", F.col("first_ts").cast("double").alias("age_s"), F.col("mid_playtime").alias("mins")), "appid", "left"), "appid")
    flags = base.na.fill(True, ["is_delisted"]).na.fill(False, ["is_vr_only", "is_utility", "is_nsfw", "is_hollow", "is_english"])
    made = to_z(t.once("flags", lambda: flags), {"age_s": "date_z", "mins": "playtime_z", "price": "price_z"})
    return made.withColumn("pop_z", F.log1p(F.col("positive") + F.col("negative")))


def recommend_request(t, **changes):
    seeds = tuple(r["appid"] for r in features(t).orderBy(F.desc("n"), "appid").select("appid").limit(2).collect())
    prompt = tuple(float(x) for x in t.vectors.orderBy(F.desc("appid")).first()["vec"])
    base = {"seeds": seeds, "prompt_vector": prompt, "semantic": 3.0, "tag": 2.0, "topic": 0.5, "quality": 1.2, "age": 0.3, "popularity": -0.2, "length": 0.1, "difficulty": 0.15,
            "price": -0.1, "difficulty_similarity": 0.4, "tone_similarity": 0.3, "switches": {"remove_utilities": True, "remove_delisted": True, "remove_vr": True}, "profile_filter": "rated"}
    return R.Request(**(base | changes))


def recommend_library(t):
    return busiest_user(t).select("appid", (F.col("rating") >= 7).alias("rated"), "playtime", F.when(F.col("rating") < 7, F.col("rating") / 10.0).alias("p_plus"))


SCORE_SQL = SEED_KERNEL_SQL + GRID_SQL + FLAGS_SQL + LAST_SQL + f"""
, me AS (SELECT user_id FROM ratings GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1), own AS (SELECT appid, rating, CASE WHEN rating < 7 THEN rating / 10.0::DOUBLE END AS pp FROM ratings WHERE user_id = (SELECT user_id FROM me)),
gq AS (SELECT g.appid, CASE WHEN pp IS NULL THEN q ELSE q + {normal.density_sql('q')} * (pp / ({normal.cdf_sql('q')} + 1e-12) - (1 - pp) / (1 - {normal.cdf_sql('q')} + 1e-12)) END AS q, pp IS NOT NULL AS is_personalized
  FROM grid g LEFT JOIN own o ON g.appid = o.appid WHERE step = 10),
pool0 AS (SELECT k.appid, k.name, theme AS s1, list_dot_product(v.vec, pv) / (sqrt(list_dot_product(v.vec, v.vec)) + 0.1) * 2 AS s2, is_hollow, vibe, topic_sim, difficulty, tone, kernel, q, is_personalized,
  epoch(c.first_ts) AS f1, ln(1 + CAST(c.n AS DOUBLE)) AS f2, c.mid_playtime AS f3, CAST(c.size AS DOUBLE) AS f4, c.price AS f5, c.n AS raw_pop
  FROM kernel k JOIN gq ON gq.appid = k.appid JOIN flagged f ON f.appid = k.appid JOIN catalogue c ON c.appid = k.appid JOIN vectors v ON v.appid = k.appid, lastv
  WHERE NOT is_utility AND NOT is_delisted AND NOT is_vr_only AND c.n > 0),
zs AS (SELECT avg(q) AS a0, stddev_pop(q) AS b0, avg(f1) AS a1, stddev_pop(f1) AS b1, avg(f2) AS a2, stddev_pop(f2) AS b2, avg(f3) AS a3, stddev_pop(f3) AS b3, avg(f4) AS a4, stddev_pop(f4) AS b4, avg(f5) AS a5, stddev_pop(f5) AS b5 FROM pool0),
pool AS (SELECT p.*, CASE WHEN is_hollow THEN 0 ELSE (s1 * exp((least(s1, s2) - s1) / 3.0) + s2 * exp((least(s1, s2) - s2) / 3.0)) / (exp((least(s1, s2) - s1) / 3.0) + exp((least(s1, s2) - s2) / 3.0)) END AS semantic_sim,
  greatest(-8, least(8, (q - a0) / b0)) AS z_quality, greatest(-8, least(8, (f1 - a1) / b1)) AS z_date, greatest(-8, least(8, (f2 - a2) / b2)) AS z_pop, greatest(-8, least(8, (f3 - a3) / b3)) AS z_length,
  greatest(-8, least(8, (f4 - a4) / b4)) AS z_difficulty, greatest(-8, least(8, (f5 - a5) / b5)) AS z_price FROM pool0 p, zs),
scored AS (SELECT *, semantic_sim * 3 + vibe * 2 + topic_sim * 0.5 + z_quality * 1.2 + z_date * 0.3 - z_pop * 0.2 + z_length * 0.1 + z_difficulty * 0.15 - z_price * 0.1 + 5 + difficulty * 0.4 + tone * 0.3
  - CASE WHEN kernel < 1e-6 THEN 20 ELSE 0 END AS score FROM pool WHERE appid NOT IN (SELECT appid FROM sd) AND appid NOT IN (SELECT appid FROM own WHERE rating >= 7))"""


@check("recommend_explained", SCORE_SQL + f"""
, top AS (SELECT * FROM scored ORDER BY score DESC, name, appid LIMIT 50),
nat AS (SELECT g.q AS cx, {normal.quantile_sql('share')} AS cy FROM grid g JOIN gp ON g.appid = gp.appid AND gp.step = g.step WHERE g.step = 10), curve AS (SELECT cx, avg(cy) AS cy FROM nat GROUP BY 1),
nb AS (SELECT appid, (score - 5) / 1.2 AS x, max(cx) FILTER (cx <= (score - 5) / 1.2) AS lo, min(cx) FILTER (cx >= (score - 5) / 1.2) AS hi FROM top CROSS JOIN curve GROUP BY 1, 2),
yy AS (SELECT nb.appid, CASE WHEN lo IS NULL THEN h.cy WHEN hi IS NULL OR hi = lo THEN l.cy ELSE l.cy + (h.cy - l.cy) * (x - lo) / (hi - lo) END AS y FROM nb LEFT JOIN curve l ON lo = l.cx LEFT JOIN curve h ON hi = h.cx)
SELECT top.appid, name, round(score, 6) AS score, round(greatest(0, least(10, score)), 6) AS weighted_score, round(100 * {normal.cdf_sql('y')}, 4) AS match_percent, is_personalized, round(semantic_sim, 6) + 0e0 AS semantic_sim,
  round(vibe, 6) + 0e0 AS tag_sim, round(z_quality, 6) + 0e0 AS z_quality, round(z_date, 6) + 0e0 AS z_date, round(z_pop, 6) + 0e0 AS z_pop, round(z_price, 6) + 0e0 AS z_price, raw_pop FROM top JOIN yy ON top.appid = yy.appid""")
def _(t):
    rate = aggregates.positive_rate(counted(t), 30).scalar()
    natural = bayes.quality(counted(t), rate, strength=20.0).select("appid", F.col("q").alias("natural_q"))
    out = R.recommend(recommend_items(t), grid(t), recommend_request(t), taxonomy(t), kernel.soul_tags(t.votes, 0.5), recommend_library(t), natural=natural)
    return out.select("appid", "name", r6("score"), r6("weighted_score"), r6("match_percent", 4), "is_personalized", r6("semantic_sim"), r6("tag_sim"), r6("z_quality"), r6("z_date"), r6("z_pop"), r6("z_price"), "raw_pop")


@check("manual_scores", SCORE_SQL + " SELECT appid, round(score, 6) AS score FROM scored")
def _(t):
    out = R.score_pool(recommend_items(t), grid(t), recommend_request(t), taxonomy(t), kernel.soul_tags(t.votes, 0.5), recommend_library(t))
    return out.select("appid", r6("score"))


@check("recommend_linear")
def _(t):
    items = recommend_items(t)
    mine = busiest_user(t)
    rating = kernel.rating_feature(features(t), mine, taxonomy(t)).join(kernel.graph_feature(t.vectors, mine), ["user_id", "appid"]).drop("user_id")
    request = recommend_request(t, coefficients={"kernel": 0.8, "graph": 0.3, "quality": 1.0, "age": -0.2, "popularity": 0.1, "length": 0.1, "difficulty": 0.0, "price": -0.1, "tone": 0.2},
                                group_coefficients={"ASIA": 0.3}, topic_coefficients=tuple(0.1 * i for i in range(10)), switches={}, profile_filter="all")
    return R.recommend(items, grid(t), request, taxonomy(t), kernel.soul_tags(t.votes, 0.5), recommend_library(t), rating_features=rating)


@check("recommend_prompt_only")
def _(t):
    request = recommend_request(t, seeds=(), profile_filter="none", genres=("econ", "promo"), top_k=30)
    return R.recommend(recommend_items(t), grid(t), request, taxonomy(t), kernel.soul_tags(t.votes, 0.5))


@check("linear_scores", FEATURES_SQL + """
, x AS (SELECT f.*, (positive - avg(positive) OVER ()) / stddev_pop(positive) OVER () AS zp FROM feat f)
SELECT appid, round(4.5 + dz * 0.7 - tz * 0.2 + zp * 0.4 + CASE WHEN list_contains(groups, 'ASIA') THEN 0.3 ELSE 0 END + topics[2] * 0.5 - topics[3] * 0.25, 6) + 0e0 AS score FROM x""")
def _(t):
    rows = to_z(features(t), {"positive": "x_quality"}).withColumns({"x_difficulty": F.col("difficulty_z"), "x_tone": F.col("tone_z")})
    request = R.Request(coefficients={"quality": 0.4, "difficulty": 0.7, "tone": -0.2}, group_coefficients={"ASIA": 0.3}, topic_coefficients=(0, 0.5, -0.25, 0, 0, 0, 0, 0, 0, 0), intercept=4.5)
    return rows.select("appid", R.linear_score(request, False).alias("score")).select("appid", r6("score"))


@check("interactive_rerank", SEED_KERNEL_SQL + """
, near AS (SELECT appid FROM kernel ORDER BY kernel.kernel DESC, appid LIMIT 200)
SELECT f.appid, round(greatest(0, least(10, 5 + dz * 1.5 - tz * 0.5)), 6) AS current_score FROM feat f JOIN near ON f.appid = near.appid WHERE NOT list_contains(tag_set, 'NATION_2') ORDER BY greatest(0, least(10, 5 + dz * 1.5 - tz * 0.5)) DESC, f.appid LIMIT 100""")
def _(t):
    from curatrix.checks.similarity import merged_seed
    rows = features(t)
    k = kernel.seed_kernel(rows, merged_seed(t, rows), taxonomy(t)).select("appid", F.col("kernel").alias("similarity"))
    out = R.rerank(rows, {"difficulty_z": 1.5, "tone_z": -0.5}, 5.0, k, 200, exclude=["NATION_2"])
    return out.select("appid", r6("current_score"))
