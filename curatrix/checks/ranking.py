"""Z-scores, ranks, lists, search and top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curatrix.checks.registry import check
from curatrix.checks.scalars import FLAGS_SQL, FOLD_NAME_SQL, flagged
from curatrix.functions import normal
from curatrix.operators import aggregates, bayes, normalize, toplists
from curatrix.operators.normalize import r6


@check("z_scores", """
, s AS (SELECT avg(size) AS m, stddev_pop(size) AS sd, avg(negative) FILTER (negative <> 0) AS mz, stddev_pop(negative) FILTER (negative <> 0) AS sz FROM catalogue)
SELECT appid, round((size - m) / sd, 6) + 0e0 AS z, round((negative - mz) / sz, 6) + 0e0 AS z_nonzero, round(greatest(-1, least(1, (size - m) / sd)), 6) + 0e0 AS z_clamped FROM catalogue, s""")
def _(t):
    out = normalize.to_z(t.catalogue, {"size": "z"})
    out = normalize.to_z(out, {"negative": "z_nonzero"}, ignore_zeros=True)
    out = normalize.to_z(out, {"size": "z_clamped"}, clamp=(-1, 1))
    return out.select("appid", r6("z"), r6("z_nonzero"), r6("z_clamped"))


@check("popularity_and_price_z", """
, p AS (SELECT appid, ln(1 + CAST(positive + negative AS DOUBLE)) AS lp, CASE WHEN appid % 3 = 0 THEN NULL ELSE ln(1 + price) END AS pr FROM catalogue),
s AS (SELECT avg(lp) AS m, stddev_pop(lp) AS sd, avg(pr) AS pm, stddev_samp(pr) AS ps FROM p)
SELECT appid, round((lp - m) / sd, 6) + 0e0 AS pop_z, round(coalesce((pr - pm) / ps, 0), 6) + 0e0 AS price_z FROM p, s""")
def _(t):
    priced = t.catalogue.withColumn("price_numeric", F.when(F.col("appid") % 3 != 0, F.col("price")))
    return normalize.price_z(normalize.popularity_z(priced)).select("appid", r6("pop_z"), r6("price_z"))


@check("quantile_scores", f"""
, r AS (SELECT appid, n, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS ra, count(*) OVER () AS c FROM catalogue),
p AS (SELECT appid, (ra - 0.5) / c AS p, ra / c AS pct FROM r)
SELECT appid, round({normal.quantile_sql('p')}, 6) + 0e0 AS score, round(pct, 6) AS pct_rank FROM p""")
def _(t):
    ranked = t.catalogue.select("appid", F.col("n").cast("double").alias("v"))
    scored = normalize.quantile_scores(ranked, "v")
    ranks = normalize.value_ranks(ranked, "v").select("v", (F.col("rank_avg") / F.col("n")).alias("pct_rank"))
    return scored.join(ranks, "v").select("appid", r6("score"), r6("pct_rank"))


@check("rank_normal_features", f"""
, f AS (SELECT appid, 'n' AS feature, CAST(n AS DOUBLE) AS v FROM catalogue UNION ALL SELECT appid, 'price', price FROM catalogue UNION ALL SELECT appid, 'flat', 1.0 FROM catalogue),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS ra, count(*) OVER (PARTITION BY feature) AS c FROM f),
p AS (SELECT *, (ra - 0.375) / (c + 0.25) AS p FROM r)
SELECT appid, feature, CASE WHEN feature = 'flat' THEN 0.0::DOUBLE ELSE round({normal.quantile_sql('p')}, 6) + 0e0 END AS z FROM p""")
def _(t):
    c = t.catalogue
    long = (c.select("appid", F.lit("n").alias("feature"), F.col("n").cast("double").alias("v"))
            .union(c.select("appid", F.lit("price"), "price")).union(c.select("appid", F.lit("flat"), F.lit(1.0))))
    return normalize.rank_normal(long, "v", ["feature"]).select("appid", "feature", r6("z"))


@check("user_percentile_ranks", """
SELECT user_id, appid, round((rank() OVER (PARTITION BY user_id ORDER BY playtime) + (count(*) OVER (PARTITION BY user_id, playtime) - 1) / 2.0)
  / count(*) OVER (PARTITION BY user_id), 6) AS pct FROM ratings""")
def _(t):
    ranked = normalize.group_ranks(t.ratings, "playtime", ["user_id"])
    return ranked.withColumn("pct", F.col("rank_avg") / F.col("n")).select("user_id", "appid", r6("pct"))


@check("curve_smoothing", """
, p AS (SELECT size AS i, avg(n) AS y FROM catalogue GROUP BY 1), w AS (SELECT a.i, sum(b.y * exp(-0.5 * power((a.i - b.i) / 3.0, 2))) / sum(exp(-0.5 * power((a.i - b.i) / 3.0, 2))) AS s
  FROM p a JOIN p b ON abs(a.i - b.i) <= 12 GROUP BY 1)
SELECT i, round(s, 6) AS smooth, i = (SELECT i FROM w ORDER BY s DESC, i LIMIT 1) AS peak FROM w""")
def _(t):
    curve = t.catalogue.groupBy(F.col("size").alias("i")).agg(F.avg("n").alias("y"))
    return toplists.smooth_curve(curve, "i", "y", 3.0).select("i", r6("smooth"), "peak")


@check("name_search", f"""
, m AS (SELECT appid, title, n, {FOLD_NAME_SQL.format(x='title')} AS f FROM catalogue WHERE contains({FOLD_NAME_SQL.format(x='title')}, 'red ring')),
t AS (SELECT * FROM m ORDER BY f = 'red ring' DESC, starts_with(f, 'red ring') DESC, n DESC, appid LIMIT 20) SELECT appid, title FROM t""")
def _(t):
    return toplists.search_names(t.catalogue, "Red: Ring", 20, "title", "n").select("appid", "title")


@check("name_listing", "SELECT name, appid FROM items ORDER BY name, appid LIMIT 1000")
def _(t):
    return toplists.names(t.items)


@check("random_subsets")
def _(t):
    return toplists.random_items(t.items, 50, 7).select("appid").withColumn("also_in_150", F.lit(True)).join(
        toplists.random_items(t.items, 150, 7).select("appid"), "appid")


@check("status_sorted", """
SELECT user_id, appid, rating FROM (SELECT *, CASE WHEN rating >= 8 THEN 0 WHEN rating >= 5 THEN 1 ELSE 2 END AS o FROM ratings) ORDER BY o, rating DESC, user_id, appid LIMIT 500""")
def _(t):
    r = F.col("rating")
    marked = t.ratings.withColumn("status", F.when(r >= 8, "rated").when(r >= 5, "played").otherwise("backlog"))
    return marked.orderBy(toplists.status_order(), F.desc("rating"), "user_id", "appid").limit(500).select("user_id", "appid", "rating")


LIST_SQL = FLAGS_SQL + """
, l AS (SELECT f.appid, coalesce(c.title, '') AS name, n AS total_reviews, first_ts AS parsed_date, mid_playtime AS estimated_playtime, c.positive, c.negative
  FROM flagged f JOIN catalogue c ON f.appid = c.appid WHERE NOT is_delisted AND NOT is_hollow AND NOT is_utility AND n >= 1)"""


def listed(t):
    c = t.catalogue.select("appid", F.col("title").alias("name"), "positive", "negative", F.col("first_ts").alias("parsed_date"), F.col("mid_playtime").alias("estimated_playtime"))
    return flagged(t).select("appid", "is_delisted", "is_hollow", "is_utility", "is_nsfw", "is_vr_only", "is_english").join(c, "appid")


def ends_sql(value: str, where: str = "true") -> str:
    return (f" SELECT * FROM (SELECT 'top' AS side, appid, name, {value} FROM l WHERE {where} ORDER BY {value} DESC, appid LIMIT 50) UNION ALL "
            f"SELECT * FROM (SELECT 'bottom' AS side, appid, name, {value} FROM l WHERE {where} ORDER BY {value}, appid LIMIT 50)")


@check("list_popularity", LIST_SQL + ends_sql("total_reviews"))
def _(t):
    return toplists.popularity_list(listed(t))


@check("list_length", LIST_SQL + ends_sql("estimated_playtime"))
def _(t):
    return toplists.length_list(listed(t))


@check("list_age", LIST_SQL + ends_sql("parsed_date", "parsed_date <= TIMESTAMP '1995-02-01'"))
def _(t):
    return toplists.age_list(listed(t), dt.datetime(1995, 2, 1))


@check("list_difficulty", LIST_SQL.replace("mid_playtime AS est", "CAST(c.negative AS DOUBLE) / n AS difficulty_predicted, mid_playtime AS est") + ends_sql("difficulty_predicted"))
def _(t):
    d = F.col("negative").cast("double") / (F.col("positive") + F.col("negative"))
    return toplists.difficulty_list(listed(t).withColumn("difficulty_predicted", d))


@check("feature_impacts", """
SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Topic ' || n_nationkey || ': ' || CASE WHEN n_nationkey < 10 THEN n_name ELSE 'Unknown Topic' END ELSE n_name END AS tag,
  n_nationkey / 10.0::DOUBLE - 1 AS impact, CASE WHEN n_nationkey % 2 = 0 THEN 'topic' ELSE 'tag' END AS type FROM nation""")
def _(t):
    n = t.table("nation")
    k = F.col("n_nationkey")
    coefficients = n.select(F.when(k % 2 == 0, F.concat(F.lit("topic_"), k.cast("string"))).otherwise(F.col("n_name")).alias("feature"), (k / 10.0 - 1).alias("coefficient"))
    return toplists.label_impacts(coefficients, n.filter("n_nationkey < 10").select(k.alias("topic"), F.col("n_name").alias("label")))


GRID_SQL = f"""
, a AS (SELECT avg(positive / CAST(n AS DOUBLE)) AS a FROM review_stats WHERE n >= 30),
steps AS (SELECT CAST(i AS INTEGER) AS step, 20.0::DOUBLE * power(80.0, -(i - 10) / 10.0) AS s FROM range(21) g(i)),
gp AS (SELECT step, appid, greatest(1e-6, least(1 - 1e-6, (positive + s * a) / (positive + negative + s))) AS share FROM review_stats, a, steps),
gr AS (SELECT *, (rank() OVER (PARTITION BY step ORDER BY share) + (count(*) OVER (PARTITION BY step, share) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY step) AS p FROM gp),
grid AS (SELECT step, appid, {normal.quantile_sql('p')} AS q FROM gr)"""


def counted(t):
    """Votes of every item without the other statistics, read by the rate, the grid and its ranks."""
    return t.once("vote counts", lambda: t.review_stats.select("appid", "positive", "negative"))


def grid(t):
    return bayes.quality_grid(counted(t), aggregates.positive_rate(counted(t), 30).scalar(), strength=20.0)


@check("quality_grid", GRID_SQL + " SELECT step, appid, round(q, 6) + 0e0 AS q FROM grid")
def _(t):
    return grid(t).select("step", "appid", r6("q"))


@check("list_quality", LIST_SQL + GRID_SQL + """
, q AS (SELECT l.appid, name, round(q, 6) + 0e0 AS quality_score FROM l JOIN grid g ON l.appid = g.appid AND step = 10)
SELECT * FROM (SELECT 'top' AS side, appid, name, quality_score FROM q ORDER BY quality_score DESC, appid LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'bottom' AS side, appid, name, quality_score FROM q ORDER BY quality_score, appid LIMIT 50)""")
def _(t):
    scores = grid(t).select("step", "appid", r6("q"))
    return toplists.quality_list(listed(t), scores, bayes.grid_step(0.0))


@check("grid_step_of_slider", """
SELECT user_id, CAST(greatest(0, least(20, round_even((avg(rating) / 5.0 - 1 + 1) / 2 * 20, 0))) AS INTEGER) AS step FROM ratings GROUP BY 1""")
def _(t):
    return t.ratings.groupBy("user_id").agg(F.avg("rating").alias("m")).select("user_id", bayes.grid_step_column(F.col("m") / 5.0 - 1).alias("step"))


@check("top_per_user", """
SELECT user_id, appid, rating, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, appid) AS rank FROM ratings) WHERE rank <= 5""")
def _(t):
    return toplists.top_k_by_group(t.ratings, ["user_id"], [F.desc("rating"), F.asc("appid")], 5).select("user_id", "appid", "rating", "rank")


@check("user_playlists", """
, s AS (SELECT r.user_id, r.appid, CAST(rating AS DOUBLE) AS projected_rating, i.price < 910 AS free, rating >= 5 AS known FROM ratings r JOIN items i ON r.appid = i.appid),
e AS (SELECT user_id, 'top' AS list, appid, projected_rating FROM s WHERE NOT known UNION ALL SELECT user_id, 'free', appid, projected_rating FROM s WHERE NOT known AND free
  UNION ALL SELECT user_id, 'backlog', appid, projected_rating FROM s WHERE known)
SELECT user_id, list, appid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, list ORDER BY projected_rating DESC, appid) AS rank FROM e) WHERE rank <= 10""")
def _(t):
    s = t.ratings.join(t.items.select("appid", "price"), "appid").withColumns({
        "projected_rating": F.col("rating").cast("double"), "free": F.col("price") < 910, "known": F.col("rating") >= 5})
    lists = {"top": ~F.col("known"), "free": ~F.col("known") & F.col("free"), "backlog": F.col("known")}
    return toplists.playlists(s, lists, 10).select("user_id", "list", "appid", "rank")


@check("scenario_rank_shifts", """
, base AS (SELECT appid, positive AS p, negative AS q, size AS z FROM catalogue), sc AS (SELECT CAST(i AS INTEGER) AS scenario, i / 4.0::DOUBLE AS w0, (i + 1) / 4.0::DOUBLE AS w1 FROM range(4) g(i)),
r AS (SELECT scenario, appid, row_number() OVER (PARTITION BY scenario ORDER BY p - q + w0 * z DESC, appid) AS r0, row_number() OVER (PARTITION BY scenario ORDER BY p - q + w1 * z DESC, appid) AS r1 FROM base, sc)
SELECT scenario, round(avg(power(r1 - r0, 2)) FILTER (r0 <= 10), 6) AS squared_shift, round(avg(abs(least(r1, 31) - least(r0, 31))) FILTER (r0 <= 30 OR r1 <= 30), 6) AS clamped_shift FROM r GROUP BY 1""")
def _(t):
    base = t.catalogue.select("appid", (F.col("positive") - F.col("negative")).cast("double").alias("fixed"), F.col("size").cast("double").alias("z"))
    scenarios = [(i, i / 4, (i + 1) / 4) for i in range(4)]
    before = {i: F.col("fixed") + w * F.col("z") for i, w, _ in scenarios}
    after = {i: F.col("fixed") + w * F.col("z") for i, _, w in scenarios}
    out = toplists.rank_shifts(base, before, after, 10, 30)
    return out.select("scenario", r6("squared_shift"), r6("clamped_shift"))


@check("target_ranks", """
, s AS (SELECT r.user_id AS seed, r.appid, r.playtime FROM ratings r), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY playtime DESC, appid) AS rank FROM s)
SELECT k.seed, k.appid AS target, CAST(rank AS INTEGER) AS rank FROM k JOIN (SELECT user_id, min(appid) AS target FROM ratings WHERE rating = 10 GROUP BY 1) t ON k.seed = t.user_id AND k.appid = t.target""")
def _(t):
    pairs = t.ratings.filter("rating = 10").groupBy(F.col("user_id").alias("seed")).agg(F.min("appid").alias("target"))
    scored = t.ratings.select(F.col("user_id").alias("seed"), "appid", F.col("playtime").alias("score"))
    return toplists.target_ranks(scored, pairs)


