"""Quality, playtime and tag scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curatrix.checks.ranking import GRID_SQL, grid
from curatrix.checks.registry import check
from curatrix.functions import normal
from curatrix.operators import aggregates, bayes, playtime, tags
from curatrix.operators.normalize import r6

RATE = 0.65
WIDTH, PRIOR = 0.688395, 1.452654


@check("smoothed_quality", f"""
, p AS (SELECT appid, greatest(1e-6, least(1 - 1e-6, (positive + 25e0 * 0.65e0) / (positive + negative + 25e0))) AS p FROM review_stats) SELECT appid, round({normal.quantile_sql('p')}, 6) + 0e0 AS q FROM p""")
def _(t):
    return bayes.quality(t.review_stats, F.lit(RATE), strength=25.0).select("appid", r6("q"))


@check("playtime_estimates", """
, s AS (SELECT appid, median(playtime) FILTER (voted_up) AS m, count(*) FILTER (voted_up) AS c FROM reviews GROUP BY 1),
b AS (SELECT i.appid, m, coalesce(c, 0) AS c, (SELECT avg(ln(1 + m)) FILTER (c > 0) FROM s) AS mu FROM items i LEFT JOIN s ON i.appid = s.appid),
k AS (SELECT appid, (c * ln(1 + coalesce(m, exp(mu) - 1)) + 1.159365 * mu) / (c + 1.159365) AS l FROM b), z AS (SELECT avg(l) AS a, stddev_pop(l) AS d FROM k)
SELECT appid, round(exp(l) - 1, 6) AS estimated_playtime, round((l - a) / d, 6) + 0e0 AS playtime_z FROM k, z""")
def _(t):
    stats = t.items.select("appid").join(aggregates.review_stats(t.reviews), "appid", "left")
    return bayes.playtime_estimates(stats).select("appid", r6("estimated_playtime"), r6("playtime_z"))


HIST_SQL = ", hist AS (SELECT appid, playtime AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (voted_up) AS DOUBLE) AS up FROM reviews WHERE playtime > 0 GROUP BY 1, 2)"
KERNEL = "exp(-0.5 * power((ln(h.x + 1e-9) - ln({x} + 1e-9)) / {w}, 2))"


@check("playtime_vote_chance", HIST_SQL + f"""
, k AS (SELECT r.user_id, r.appid, r.playtime, sum(n * {KERNEL.format(x='r.playtime', w=WIDTH)}) AS t, sum(up * {KERNEL.format(x='r.playtime', w=WIDTH)}) AS p FROM ratings r JOIN hist h ON r.appid = h.appid GROUP BY 1, 2, 3)
SELECT user_id, appid, round((p + {PRIOR} * {RATE}) / (t + {PRIOR}), 6) AS p_plus FROM k""")
def _(t):
    asked = t.ratings.select("appid", F.col("playtime").alias("x"))
    chance = playtime.vote_probability(asked, playtime.vote_histogram(t.reviews), F.lit(RATE))
    return t.ratings.join(chance, (t.ratings["appid"] == chance["appid"]) & (t.ratings["playtime"] == chance["x"])).select("user_id", t.ratings["appid"], r6("p_plus"))


@check("leave_one_out_votes", HIST_SQL + f"""
, k AS (SELECT a.appid, a.x, a.n, a.up, sum(h.n * {KERNEL.format(x='a.x', w=WIDTH)}) AS t, sum(h.up * {KERNEL.format(x='a.x', w=WIDTH)}) AS p FROM hist a JOIN hist h ON a.appid = h.appid GROUP BY 1, 2, 3, 4)
SELECT appid, x, true AS voted_up, CAST(up AS BIGINT) AS n, round((p - 1 + {PRIOR} * {RATE}) / (t - 1 + {PRIOR}), 6) AS p_plus FROM k WHERE up > 0
UNION ALL SELECT appid, x, false, CAST(n - up AS BIGINT), round((p + {PRIOR} * {RATE}) / (t - 1 + {PRIOR}), 6) FROM k WHERE n > up""")
def _(t):
    return playtime.leave_one_out(playtime.vote_histogram(t.reviews), F.lit(RATE)).select("appid", "x", "voted_up", "n", r6("p_plus"))


WIDTHS, PRIORS = [0.05, 0.2, 0.7, 2.0], [0.1, 1.5, 20.0]


@check("playtime_likelihood_grid", HIST_SQL + f"""
, g AS (SELECT unnest({WIDTHS}::DOUBLE[]) AS width), s AS (SELECT unnest({PRIORS}::DOUBLE[]) AS prior), ok AS (SELECT appid FROM hist GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT width, a.appid, a.x, a.n, a.up, sum(h.n * {KERNEL.format(x='a.x', w='width')}) AS t, sum(h.up * {KERNEL.format(x='a.x', w='width')}) AS p FROM hist a JOIN hist h ON a.appid = h.appid CROSS JOIN g
  WHERE a.appid IN (SELECT appid FROM ok) GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT width, prior, sum(up * ln(greatest(1e-12, least(1 - 1e-12, (p - 1 + prior * {RATE}) / (t - 1 + prior)))) + (n - up) * ln(1 - greatest(1e-12, least(1 - 1e-12, (p + prior * {RATE}) / (t - 1 + prior))))) AS ll FROM k, s GROUP BY 1, 2)
SELECT width, prior, round(ll, 4) AS log_likelihood FROM l""")
def _(t):
    out = playtime.likelihood_grid(playtime.vote_histogram(t.reviews), RATE, WIDTHS, PRIORS)
    return out.select("width", "prior", r6("log_likelihood", 4))


@check("playtime_best_parameters")
def _(t):
    widths, priors = [float(x) for x in np.geomspace(0.05, 10, 15)], [float(x) for x in np.geomspace(0.01, 100, 15)]
    return playtime.best_parameters(playtime.likelihood_grid(playtime.vote_histogram(t.reviews), RATE, widths, priors))


@check("playtime_best_of_75")
def _(t):
    """The default grid of the survey: 75 widths and 75 prior weights."""
    widths, priors = [float(x) for x in np.geomspace(0.05, 10, 75)], [float(x) for x in np.geomspace(0.01, 100, 75)]
    return playtime.best_parameters(playtime.likelihood_grid(playtime.vote_histogram(t.reviews), RATE, widths, priors))


@check("response_curves", HIST_SQL + f"""
, x AS (SELECT unnest([1, 5, 20, 60, 240]::DOUBLE[]) AS x), k AS (SELECT h.appid, x.x, sum(n * {KERNEL.format(x='x.x', w=WIDTH)}) AS t, sum(up * {KERNEL.format(x='x.x', w=WIDTH)}) AS p FROM hist h, x GROUP BY 1, 2)
SELECT appid, x, round((p + {PRIOR} * {RATE}) / (t + {PRIOR}), 6) AS p_plus FROM k""")
def _(t):
    return playtime.response_curve(playtime.vote_histogram(t.reviews), F.lit(RATE), [1, 5, 20, 60, 240]).select("appid", "x", r6("p_plus"))


def personal_sql(q: str, p: str) -> str:
    return f"({q} + {normal.density_sql(q)} * ({p} / ({normal.cdf_sql(q)} + 1e-12) - (1 - {p}) / (1 - {normal.cdf_sql(q)} + 1e-12)))"


SOFT_SQL = HIST_SQL + f"""
, lib AS (SELECT user_id, appid, CASE WHEN rating = 4 THEN 0 ELSE playtime END AS playtime, CASE WHEN rating >= 9 THEN true WHEN rating = 0 THEN false END AS up FROM ratings),
gp AS (SELECT l.*, greatest(1e-6, least(1 - 1e-6, (positive + 25e0 * {RATE}e0) / (positive + negative + 25e0))) AS gp FROM lib l JOIN review_stats s ON l.appid = s.appid),
gq AS (SELECT *, {normal.quantile_sql('gp')} AS gq FROM gp),
k AS (SELECT l.user_id, l.appid, (sum(h.up * {KERNEL.format(x='l.playtime', w=WIDTH)}) + {PRIOR} * {RATE}) / (sum(n * {KERNEL.format(x='l.playtime', w=WIDTH)}) + {PRIOR}) AS kp
  FROM lib l JOIN hist h ON l.appid = h.appid WHERE l.playtime > 0 GROUP BY 1, 2),
pp AS (SELECT g.*, CASE WHEN playtime <= 0 THEN gp WHEN up THEN 1e0 WHEN NOT up THEN 0e0 ELSE coalesce(kp, gp) END AS pp FROM gq g LEFT JOIN k ON g.user_id = k.user_id AND g.appid = k.appid),
soft AS (SELECT *, CASE WHEN playtime <= 0 THEN gq ELSE {personal_sql('gq', 'pp')} END AS pq FROM pp)"""


def library(t):
    r = F.col("rating")
    return t.ratings.select("user_id", "appid", F.when(r == 4, 0.0).otherwise(F.col("playtime")).alias("playtime"), F.when(r >= 9, True).when(r == 0, False).alias("user_voted_up"))


@check("soft_labels", SOFT_SQL + """
SELECT user_id, appid, playtime, round(gq, 6) + 0e0 AS global_q, round(pp, 6) AS p_plus, round(pq, 5) + 0e0 AS personalized_q,
  CASE WHEN playtime <= 0 THEN 5 ELSE CAST(greatest(0, least(10, round_even(round(pq, 9) * 3.008809 + 3.277190, 0))) AS INTEGER) END AS predicted_rating, playtime > 0 AS has_playtime FROM soft""")
def _(t):
    s = playtime.soft_labels(library(t), t.review_stats, t.reviews, F.lit(RATE), strength=25.0)
    return s.select("user_id", "appid", "playtime", r6("global_q"), r6("p_plus"), r6("personalized_q", 5), "predicted_rating", "has_playtime")


@check("personalized_ranking_quality", GRID_SQL + f"""
, me AS (SELECT user_id FROM ratings GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1), own AS (SELECT appid, rating / 10.0::DOUBLE AS p FROM ratings WHERE user_id = (SELECT user_id FROM me))
SELECT g.appid, round(CASE WHEN p IS NULL THEN q ELSE {personal_sql('q', 'p')} END, 6) + 0e0 AS q, p IS NOT NULL AS is_personalized FROM grid g LEFT JOIN own o ON g.appid = o.appid WHERE step = 10""")
def _(t):
    from curatrix.checks.scalars import busiest_user
    own = busiest_user(t).select("appid", (F.col("rating") / 10.0).alias("p_plus"))
    return bayes.personalize_owned(grid(t).filter("step = 10").select("appid", "q"), own).select("appid", r6("q"), "is_personalized")


@check("match_percent", GRID_SQL + f"""
, nat AS (SELECT g.appid, q AS cx, {normal.quantile_sql('share')} AS cy FROM grid g JOIN gp ON g.appid = gp.appid AND gp.step = g.step WHERE g.step = 10),
curve AS (SELECT cx, avg(cy) AS cy FROM nat GROUP BY 1), s AS (SELECT appid, (size / 5.0::DOUBLE - 5) / 2 AS x FROM items),
n AS (SELECT appid, x, max(cx) FILTER (cx <= x) AS lo, min(cx) FILTER (cx >= x) AS hi FROM s CROSS JOIN curve GROUP BY 1, 2),
y AS (SELECT n.appid, CASE WHEN lo IS NULL THEN h.cy WHEN hi IS NULL OR hi = lo THEN l.cy ELSE l.cy + (h.cy - l.cy) * (x - lo) / (hi - lo) END AS y FROM n LEFT JOIN curve l ON lo = l.cx LEFT JOIN curve h ON hi = h.cx)
SELECT appid, round(100 * {normal.cdf_sql('y')}, 5) AS match_percent FROM y""")
def _(t):
    rate = aggregates.positive_rate(t.review_stats, 30).scalar()
    natural = bayes.quality(t.review_stats, rate, strength=20.0).select("appid", F.col("q").alias("cy"))
    curve = grid(t).filter("step = 10").join(natural, "appid").select(F.col("q").alias("cx"), "cy")
    scored = t.items.select("appid", (F.col("size") / 5.0).alias("score"))
    return bayes.match_percent(scored, "score", curve, 2.0).select("appid", r6("match_percent", 5))


@check("implied_strength", """SELECT appid, round((positive - (positive + 25 * 0.65) / (n + 25) * n) / ((positive + 25 * 0.65) / (n + 25) - 0.65), 4) AS strength FROM review_stats
WHERE abs(positive / CAST(n AS DOUBLE) - 0.65) > 1e-9""")
def _(t):
    share = (F.col("positive") + 25 * 0.65) / (F.col("n") + 25)
    rows = t.review_stats.filter(F.abs(F.col("positive") / F.col("n") - 0.65) > 1e-9)
    return rows.withColumn("strength", bayes.implied_strength(share, F.lit(0.65))).select("appid", r6("strength", 4))


STRENGTHS = [float(x) for x in np.geomspace(0.1, 100, 13)]


def strength_sql(grid: str, least: int = 20) -> str:
    """Sample medians by the binomial tail: the middle of m draws is at most x if at least (m + 1) / 2 draws are."""
    def tail(share: str) -> str:
        log = f"lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln({share}) + (m - j) * ln(1 - {share})"
        return f"CASE WHEN {share} <= 0 THEN 0e0 WHEN {share} >= 1 THEN 1e0 ELSE list_sum(list_transform(range((m + 1) // 2, m + 1), lambda j: exp({log}))) END"

    return f"""
, ups AS (SELECT appid, playtime AS x, count(*) AS n FROM reviews WHERE voted_up AND playtime > 0 GROUP BY 1, 2), cnt AS (SELECT appid, sum(n)::BIGINT AS total FROM ups GROUP BY 1),
cls AS (SELECT appid, total, 2 * (CAST(floor(CASE WHEN total <= 32 THEN total ELSE floor(power(2e0, floor(log2(total) * 8 + 1e-9) / 8) + 1e-9) END / 2e0) AS BIGINT)) + 1 AS m FROM cnt),
sz AS (SELECT m, count(*) / CAST((SELECT count(*) FROM cls) AS DOUBLE) AS w FROM cls GROUP BY 1),
med AS (SELECT r.appid, ln(1 + median(playtime)) AS t FROM reviews r JOIN cnt c ON r.appid = c.appid WHERE voted_up AND playtime > 0 AND total >= {least} GROUP BY 1),
lv AS (SELECT u.appid, ln(1 + x) AS y, (sum(n) OVER (PARTITION BY u.appid ORDER BY x) - n) / CAST(total AS DOUBLE) AS lo, sum(n) OVER (PARTITION BY u.appid ORDER BY x) / CAST(total AS DOUBLE) AS hi
  FROM ups u JOIN cnt c ON u.appid = c.appid WHERE total >= {least}),
pr AS (SELECT appid, m, w, y, {tail('hi')} - {tail('lo')} AS p FROM lv, sz),
mo AS (SELECT pr.appid, m, any_value(w) AS w, sum(y * p) AS a, sum(y * y * p) AS b, any_value(t) AS t FROM pr JOIN med ON pr.appid = med.appid GROUP BY 1, 2),
mu AS (SELECT avg(t) AS mu FROM med), cs AS (SELECT unnest({grid}) AS c),
loss AS (SELECT c AS strength, sum(w * ((m * m * b + 2 * m * c * mu * a + c * c * mu * mu) / ((m + c) * (m + c)) - 2 * t * (m * a + c * mu) / (m + c) + t * t)) / sum(w) AS loss FROM mo, mu, cs GROUP BY 1)"""


@check("playtime_strength_losses", strength_sql(f"{STRENGTHS}::DOUBLE[]") + " SELECT round(strength, 6) AS strength, round(loss, 7) AS loss FROM loss")
def _(t):
    moments = playtime.median_moments(playtime.vote_histogram(t.reviews.filter("voted_up")), least=20)
    return playtime.strength_loss(moments, playtime.median_prior(moments), STRENGTHS).select(r6("strength"), r6("loss", 7))


@check("playtime_strength")
def _(t):
    best = playtime.playtime_strength(playtime.vote_histogram(t.reviews.filter("voted_up")), least=20)
    return t.spark.createDataFrame([(best,)], "strength double")


# ----------------------------------------------------------------------------- tags

TAG_CTES = """
, tl AS (SELECT n_name AS tag FROM nation), totals AS (SELECT appid, sum(votes) AS total FROM votes GROUP BY 1),
prior AS (SELECT tag, sum(votes) / CAST((SELECT sum(votes) FROM votes) AS DOUBLE) AS g FROM votes GROUP BY 1),
smooth AS (SELECT o.appid, p.tag, total, g, (coalesce(votes, 0) + 8 * g) / (total + 8) AS share FROM totals o CROSS JOIN prior p LEFT JOIN votes v ON v.appid = o.appid AND v.tag = p.tag)"""


def smoothed(t):
    names = tags.tag_list(t.votes)
    prior = {r["tag"]: r["share"] for r in aggregates.tag_prior(t.votes).collect()}
    g = [prior[x] for x in names]
    return names, g, tags.smoothed_profiles(tags.dense(t.votes, names), g, 8.0)


def exploded(df, names, column, digits=6):
    order = F.array(*[F.lit(x) for x in names])
    return df.select("appid", F.posexplode(column).alias("i", "x")).select("appid", F.element_at(order, F.col("i") + 1).alias("tag"), r6("x", digits))


@check("observed_tags", """
, r AS (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY votes DESC, tag) AS rank FROM votes), k AS (SELECT *, count(*) OVER (PARTITION BY appid) AS shown, min(votes) OVER (PARTITION BY appid) AS cap FROM r WHERE rank <= 20)
SELECT appid, tag, votes, CAST(rank AS INTEGER) AS rank, cap, shown >= 20 AS censored FROM k""")
def _(t):
    return tags.observed_tags(t.votes)


@check("smoothed_profiles", TAG_CTES + " SELECT appid, tag, round(share, 7) AS x FROM smooth")
def _(t):
    names, _, rows = smoothed(t)
    return exploded(rows, names, "profile", 7)


@check("tag_transform_clr", TAG_CTES + """
, p0 AS (SELECT avg(ln(g + 1e-9)) AS m FROM prior), l AS (SELECT *, ln(share + 1e-9) - avg(ln(share + 1e-9)) OVER (PARTITION BY appid) AS c FROM smooth)
SELECT appid, tag, round(c - (ln(g + 1e-9) - m), 6) + 0e0 AS x FROM l, p0""")
def _(t):
    names, g, rows = smoothed(t)
    return exploded(tags.transform_profiles(rows, g, "clr"), names, "vec")


@check("tag_transform_anscombe", TAG_CTES + """
, a AS (SELECT avg(total) AS n FROM totals), p0 AS (SELECT sum(2 * sqrt(g * n + 0.375)) AS s FROM prior, a),
r AS (SELECT *, 2 * sqrt(share * n + 0.375) AS v, 2 * sqrt(g * n + 0.375) AS v0 FROM smooth, a)
SELECT appid, tag, round(v / sum(v) OVER (PARTITION BY appid) - v0 / s, 6) + 0e0 AS x FROM r, p0""")
def _(t):
    names, g, rows = smoothed(t)
    mean_total = rows.agg(F.avg("total").alias("x")).first()["x"]
    return exploded(tags.transform_profiles(rows, g, "anscombe", mean_total), names, "vec")


@check("imputed_tags")
def _(t):
    names = tags.tag_list(t.votes)
    rows, _ = tags.impute(t.votes, names, reliable=30)
    return exploded(rows.withColumnRenamed("counts", "vec"), names, "vec")


@check("detection_limit_imputation")
def _(t):
    names = tags.tag_list(t.votes)
    return exploded(tags.limit_of_detection(t.votes, names, reliable=30), names, "counts")


@check("smoothing_loss", TAG_CTES + """
, c AS (SELECT l_partkey AS appid, n_name AS tag, CAST(count(*) AS DOUBLE) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber <= 2 GROUP BY 1, 2),
n AS (SELECT appid, sum(c) AS n FROM c GROUP BY 1), k AS (SELECT unnest([0.5, 2, 8, 30, 120]::DOUBLE[]) AS k),
d AS (SELECT n.appid, p.tag, n, coalesce(c, 0) AS c, coalesce(votes, 0) / CAST(total AS DOUBLE) AS truth, p.g FROM n CROSS JOIN prior p LEFT JOIN c ON c.appid = n.appid AND c.tag = p.tag
  LEFT JOIN votes v ON v.appid = n.appid AND v.tag = p.tag JOIN totals o ON o.appid = n.appid)
SELECT k, round(sum(power((c + k * g) / (n + k) - truth, 2)), 5) AS loss FROM d, k GROUP BY 1""")
def _(t):
    names, g, _ = smoothed(t)
    dims = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("tag"))
    few = (t.table("lineitem").filter("l_linenumber <= 2").join(dims, F.col("l_suppkey") == F.col("s_suppkey"))
           .groupBy(F.col("l_partkey").alias("appid"), "tag").agg(F.count("*").alias("votes")))
    truth = tags.dense(t.votes, names).withColumn("_t", F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)).select(
        "appid", F.transform("counts", lambda x: x / F.col("_t")).alias("g"))
    samples = tags.dense(few, names, target="c").join(truth, "appid")
    return tags.smoothing_loss(samples, g, [0.5, 2, 8, 30, 120]).select("k", r6("loss", 5))


@check("smoothing_loss_resampled", TAG_CTES + """
, tot AS (SELECT appid, CAST(sum(votes) AS DOUBLE) AS n FROM votes GROUP BY 1),
d AS (SELECT o.appid, p.tag, p.g, coalesce(v.votes, 0) / o.n AS pr FROM tot o CROSS JOIN prior p LEFT JOIN votes v ON v.appid = o.appid AND v.tag = p.tag WHERE o.n >= 30),
s AS (SELECT sum(pr * (1 - pr)) AS noise, sum((g - pr) * (g - pr)) AS bias FROM d), z AS (SELECT n, count(*) AS m FROM tot GROUP BY 1), k AS (SELECT unnest([0.5, 2, 8, 30, 120, 1000]::DOUBLE[]) AS k)
SELECT k, round(sum(m * (n * noise + k * k * bias) / power(n + k, 2)) / sum(m), 6) AS loss FROM k, z, s GROUP BY 1""")
def _(t):
    names, g, _ = smoothed(t)
    rows = tags.dense(t.votes, names).withColumn("votes", F.aggregate("counts", F.lit(0.0), lambda a, x: a + x))
    return tags.expected_smoothing_loss(rows, g, [0.5, 2, 8, 30, 120, 1000], reliable=30).select("k", r6("loss"))


@check("whitened_tag_vectors")
def _(t):
    t.keep("votes")
    return tags.tag_vectors(t.votes, reliable=30)


ACTIVE_SQL = ", active AS (SELECT appid, tag FROM (SELECT *, max(votes) OVER (PARTITION BY appid) AS top FROM votes) WHERE votes / CAST(top AS DOUBLE) >= 0.5)"


def active(t):
    return tags.active_tags(t.votes, share=0.5)


@check("tag_idf", ACTIVE_SQL + " SELECT tag, count(*) AS df, round(ln((SELECT count(DISTINCT appid) FROM active) / CAST(count(*) + 1 AS DOUBLE)) + 1, 6) AS idf FROM active GROUP BY 1")
def _(t):
    return tags.idf(active(t)).select("tag", "df", r6("idf"))


PAIR_SQL = ACTIVE_SQL + """
, df AS (SELECT tag, count(*) AS d FROM active GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM items),
co AS (SELECT a.tag AS x, b.tag AS y, count(*) AS c FROM active a JOIN active b ON a.appid = b.appid AND a.tag < b.tag GROUP BY 1, 2),
pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, coalesce(c, 0) AS n_both, coalesce(c, 0) / CAST(a.d + b.d - coalesce(c, 0) AS DOUBLE) AS jaccard,
  (n * coalesce(c, 0) - a.d * b.d) / (sqrt(a.d * (n - a.d)) * sqrt(b.d * (n - b.d))) AS phi FROM df a JOIN df b ON a.tag < b.tag CROSS JOIN n LEFT JOIN co ON x = a.tag AND y = b.tag)"""


@check("tag_cooccurrence", PAIR_SQL + " SELECT tag_a, tag_b, n_both, round(jaccard, 6) AS jaccard, round(phi, 6) + 0e0 AS phi FROM pairs")
def _(t):
    return tags.cooccurrence(active(t), t.items, tags.tag_list(t.votes)).select("tag_a", "tag_b", "n_both", r6("jaccard"), r6("phi"))


def tag_graph(t):
    names, rows = tags.tag_list(t.votes), active(t)
    return names, rows, tags.similarity_matrix(tags.cooccurrence(rows, t.items, names), len(names))


SIM_SQL = """
, sim AS (SELECT tag_a AS a, tag_b AS b, jaccard AS s FROM pairs UNION ALL SELECT tag_b, tag_a, jaccard FROM pairs UNION ALL SELECT tag, tag, 1.0 FROM df),
w AS (SELECT tag, ln((SELECT count(DISTINCT appid) FROM active) / CAST(d + 1 AS DOUBLE)) + 1 AS w FROM df)"""


def heat_sql(time: float = 2.0, terms: int = 24) -> str:
    """The heat kernel as a power series of the scaled adjacency, unit diagonal."""
    parts = ["""
, adj AS (SELECT a, b, s FROM sim WHERE a <> b), dg AS (SELECT a, CASE WHEN sum(s) > 0 THEN 1 / sqrt(sum(s) + 1e-9) ELSE 0 END AS r FROM adj GROUP BY 1),
nm AS MATERIALIZED (SELECT adj.a, adj.b, s * x.r * y.r AS v FROM adj JOIN dg x ON adj.a = x.a JOIN dg y ON adj.b = y.a), p0 AS MATERIALIZED (SELECT tag AS a, tag AS b, 1e0 AS v FROM df)"""]
    parts += [f"p{k} AS MATERIALIZED (SELECT p.a, n.b, sum(p.v * n.v) * {time / k!r}::DOUBLE AS v FROM p{k - 1} p JOIN nm n ON p.b = n.a GROUP BY 1, 2)" for k in range(1, terms + 1)]
    every = " UNION ALL ".join(f"SELECT a, b, v FROM p{k}" for k in range(terms + 1))
    parts += [f"ht AS MATERIALIZED (SELECT a, b, sum(v) AS v FROM ({every}) GROUP BY 1, 2)",
              "heat AS (SELECT h.a, h.b, h.v / sqrt(x.v * y.v) AS s FROM ht h JOIN ht x ON x.a = h.a AND x.b = h.a JOIN ht y ON y.a = h.b AND y.b = h.b)"]
    return ", ".join(parts)


@check("tag_diffusion", PAIR_SQL + SIM_SQL + heat_sql() + " SELECT a AS tag_a, b AS tag_b, round(s, 6) AS s FROM heat")
def _(t):
    names, _, sim = tag_graph(t)
    spread = tags.diffuse(sim)
    rows = [(names[i], names[j], float(spread[i, j])) for i in range(len(names)) for j in range(len(names))]
    return t.spark.createDataFrame(rows, "tag_a string, tag_b string, s double").select("tag_a", "tag_b", r6("s"))


@check("tag_diffusion_time")
def _(t):
    _, _, sim = tag_graph(t)
    times = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
    return t.spark.createDataFrame(list(zip(times, tags.diffusion_time(sim, times)[1])), "time double, score double")


def weights(rows, names):
    found = {r["tag"]: r["idf"] for r in tags.idf(rows).collect()}  # one number per tag
    return [found.get(n, 1.0) for n in names]


IMPLICIT = ["NATION_1", "NATION_4", "NATION_9"]


@check("diffused_profiles", PAIR_SQL + SIM_SQL + heat_sql() + f"""
SELECT appid, b AS tag, round(sum(w * CASE WHEN active.tag IN {tuple(IMPLICIT)} THEN 0.5 ELSE 1 END * s), 6) AS x FROM active JOIN w ON active.tag = w.tag JOIN heat ON a = active.tag GROUP BY 1, 2""")
def _(t):
    names, rows, sim = tag_graph(t)
    return exploded(tags.diffused_profiles(rows, names, weights(rows, names), tags.diffuse(sim), IMPLICIT), names, "profile")


SEED_TAGS = ["NATION_3", "NATION_7", "NATION_12"]


@check("chamfer_similarity", PAIR_SQL + SIM_SQL + f"""
, best AS (SELECT a AS tag, max(s) AS m FROM sim WHERE b IN {tuple(SEED_TAGS)} GROUP BY 1),
fwd AS (SELECT appid, sum(w * m) / sum(w) AS f FROM active JOIN w ON active.tag = w.tag JOIN best ON best.tag = active.tag GROUP BY 1),
bk AS (SELECT appid, b, max(s) AS m FROM active JOIN sim ON a = active.tag WHERE b IN {tuple(SEED_TAGS)} GROUP BY 1, 2),
bwd AS (SELECT appid, sum(m * w) / sum(w) AS g FROM bk JOIN w ON w.tag = b GROUP BY 1)
SELECT fwd.appid, round(f, 6) AS to_seed, round(g, 6) AS from_seed, round(greatest(f, g), 6) AS similarity FROM fwd JOIN bwd ON fwd.appid = bwd.appid""")
def _(t):
    names, rows, sim = tag_graph(t)
    out = tags.chamfer(rows, names, weights(rows, names), sim, SEED_TAGS)
    return out.select("appid", r6("to_seed"), r6("from_seed"), r6("similarity"))


