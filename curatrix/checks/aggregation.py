"""Aggregations, distributions and second moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.checks.registry import check
from curatrix.functions import normal
from curatrix.functions import vectors as V
from curatrix.operators import aggregates as A
from curatrix.operators import matrix, toplists
from curatrix.operators.normalize import r6

DIMS = 64


@check("review_stats", """
SELECT appid, count(*) FILTER (voted_up) AS positive, count(*) FILTER (NOT voted_up) AS negative,
  median(playtime) FILTER (voted_up AND playtime > 0) AS median_playtime, count(*) FILTER (voted_up AND playtime > 0) AS review_count FROM reviews GROUP BY 1""")
def _(t):
    return A.review_stats(t.reviews)


@check("bundled_texts", """
, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, CAST(doc_id AS VARCHAR)) AS rn FROM documents)
SELECT source AS appid, string_agg(text, ' ' ORDER BY rn) AS bundle FROM r WHERE rn <= 5 GROUP BY 1""")
def _(t):
    docs = t.table("documents").select(F.col("source").alias("appid"), F.col("n_chars").alias("ts"), F.col("doc_id").cast("string").alias("review_id"), "text")
    return A.bundle_text(docs, 5)


@check("assembled_texts", """
, r AS (SELECT source, string_agg(text, ' | ' ORDER BY n_chars, doc_id) AS whole FROM documents GROUP BY 1)
SELECT source AS appid, part, substr(whole, CAST(part AS INTEGER) * 5000 + 1, 5000) AS text FROM (SELECT source, whole, unnest(range((length(whole) + 4999) // 5000)) AS part FROM r)""")
def _(t):
    docs = t.table("documents").select(F.col("source").alias("appid"), "n_chars", "doc_id", "text")
    return A.assembled_text(docs, "appid", ["n_chars", "doc_id"], piece=5000)


@check("positive_rate", """
SELECT 'reliable' AS how, round(avg(positive / CAST(n AS DOUBLE)) FILTER (n >= 30), 6) AS rate FROM catalogue
UNION ALL SELECT 'pooled', round(sum(positive) / CAST(sum(n) AS DOUBLE), 6) FROM catalogue""")
def _(t):
    some = A.positive_rate(t.review_stats, 30).select(F.lit("reliable").alias("how"), r6("rate"))
    return some.unionByName(A.positive_rate(t.review_stats, 10**9).select(F.lit("pooled").alias("how"), r6("rate")))


@check("vocabularies", """
SELECT 'genre' AS kind, name FROM (SELECT DISTINCT trim(unnest(string_split(CASE WHEN genres LIKE '[%' THEN regexp_replace(genres, '[\\[\\]''"]', '', 'g') ELSE genres END, ','))) AS name FROM raw_items) WHERE name <> ''
UNION ALL SELECT 'tag', name FROM (SELECT DISTINCT unnest(regexp_extract_all(tags, '''([^'']*)''\\s*:', 1)) AS name FROM raw_items)""")
def _(t):
    from curatrix.operators.filters import genre_array, tag_map
    raw = t.raw_items.select(genre_array().alias("g"), F.map_keys(tag_map()).alias("t"))
    return A.vocabulary(raw, "g", "genre").unionByName(A.vocabulary(raw, "t", "tag"))


@check("tag_shares", """
, s AS (SELECT appid FROM items WHERE genre = 'PROMO'), b AS (SELECT count(DISTINCT appid) AS n, count(DISTINCT appid) FILTER (appid IN (SELECT appid FROM s)) AS m FROM votes)
SELECT tag, count(*) AS items, count(*) FILTER (appid IN (SELECT appid FROM s)) AS items_within, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS share,
  round(count(*) FILTER (appid IN (SELECT appid FROM s)) / CAST(any_value(m) AS DOUBLE), 6) AS share_within FROM votes, b GROUP BY 1""")
def _(t):
    out = A.tag_shares(t.votes, t.items.filter("genre = 'PROMO'"))
    return out.select("tag", "items", "items_within", r6("share"), r6("share_within"))


@check("keys_with_rows", "SELECT appid, count(*) AS count FROM reviews WHERE playtime > 0 GROUP BY 1 HAVING count(*) >= 35")
def _(t):
    return A.keys_with_rows(t.reviews, 35)


DIM_SQL = ", dims AS (SELECT appid, label, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM vectors)"


@check("dimension_moments", DIM_SQL + " SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) + 0e0 AS mean, round(stddev_pop(x), 6) AS std FROM dims GROUP BY 1")
def _(t):
    return A.dimension_moments(t.vectors).select("dim", r6("mean"), r6("std"))


@check("covariance_matrix", DIM_SQL + """
, m AS (SELECT dim, avg(x) AS mu FROM dims GROUP BY 1), c AS (SELECT d.appid, d.dim, x - mu AS x FROM dims d JOIN m ON d.dim = m.dim)
SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(avg(a.x * b.x), 6) + 0e0 AS cov FROM c a JOIN c b ON a.appid = b.appid GROUP BY 1, 2""")
def _(t):
    return matrix.covariance(t.vectors, "vec", DIMS).select("i", "j", r6("cov"))


@check("dimension_correlations", DIM_SQL + """
SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(corr(a.x, b.x), 6) + 0e0 AS r FROM dims a JOIN dims b ON a.appid = b.appid AND a.dim < b.dim GROUP BY 1, 2""")
def _(t):
    return matrix.correlations(t.vectors, "vec", DIMS).select("i", "j", r6("r"))


@check("target_correlations", DIM_SQL + """
, c AS (SELECT dim, corr(x, n) AS r FROM dims d JOIN catalogue c ON d.appid = c.appid GROUP BY 1)
SELECT CAST(dim AS INTEGER) AS dim, round(r, 6) + 0e0 AS r FROM c""")
def _(t):
    long = t.vectors.join(t.review_stats.select("appid", "n"), "appid").select(F.posexplode("vec").alias("dim", "x"), F.col("n").cast("double").alias("n"))
    return long.groupBy("dim").agg(F.corr("x", "n").alias("r")).select("dim", r6("r"))


@check("covariance_report", DIM_SQL + """
, m AS (SELECT dim, avg(x) AS mu FROM dims GROUP BY 1), c AS (SELECT d.appid, d.dim, x - mu AS x FROM dims d JOIN m ON d.dim = m.dim),
k AS (SELECT a.dim AS i, b.dim AS j, avg(a.x * b.x) AS cov FROM c a JOIN c b ON a.appid = b.appid GROUP BY 1, 2)
SELECT round(sqrt(sum(power(cov - CASE WHEN i = j THEN 1 ELSE 0 END, 2))), 6) AS frobenius_to_identity, round(avg(abs(cov)) FILTER (i <> j), 6) AS mean_off_diagonal,
  round(max(abs(cov)) FILTER (i <> j), 6) AS max_off_diagonal, count(*) FILTER (i = j AND cov < 1e-9) AS flat_dims, round(avg(cov) FILTER (i = j), 6) AS mean_variance FROM k""")
def _(t):
    r = matrix.covariance_report(t.vectors, "vec", DIMS)
    return r.select("flat_dims", *[r6(c) for c in ("frobenius_to_identity", "mean_off_diagonal", "max_off_diagonal", "mean_variance")])


@check("variance_spectrum")
def _(t):
    return matrix.spectrum(t.vectors, "vec", DIMS)


@check("tag_priors", """
, totals AS (SELECT appid, sum(votes) AS t FROM votes GROUP BY 1)
SELECT 'pooled' AS how, tag, round(sum(votes) / CAST((SELECT sum(votes) FROM votes) AS DOUBLE), 6) AS share FROM votes GROUP BY 2
UNION ALL SELECT 'profiles', tag, round(sum(votes / CAST(t AS DOUBLE)) / (SELECT count(*) FROM totals WHERE t > 30), 6) FROM votes v JOIN totals o ON v.appid = o.appid WHERE t > 30 GROUP BY 2""")
def _(t):
    a = A.tag_prior(t.votes).select(F.lit("pooled").alias("how"), "tag", r6("share"))
    return a.unionByName(A.mean_profile(t.votes, 30).select(F.lit("profiles").alias("how"), "tag", r6("share")))


@check("family_overlap", """
, f AS (SELECT appid, bool_or(tag IN ('NATION_1', 'NATION_2')) AS fam, bool_or(tag IN ('NATION_7', 'NATION_8')) AS oth FROM votes GROUP BY 1),
c AS (SELECT count(*) FILTER (fam) AS n_family, count(*) FILTER (fam AND oth) AS n_both FROM f),
r AS (SELECT f.appid, n, row_number() OVER (ORDER BY n DESC, f.appid) AS rank FROM f JOIN catalogue k ON f.appid = k.appid WHERE fam AND oth)
SELECT CAST(rank AS INTEGER) AS rank, appid, n, n_family, n_both, round(n_both / CAST(n_family AS DOUBLE), 6) AS share FROM r, c WHERE rank <= 5""")
def _(t):
    out = A.family_overlap(t.votes, t.review_stats, ["NATION_1", "NATION_2"], ["NATION_7", "NATION_8"])
    return out.select("rank", "appid", "n", "n_family", "n_both", r6("share"))


@check("distribution_summary", """
, m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem)
SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(any_value(sd), 4) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  round(avg(power((l_extendedprice - mu) / sd, 3)), 6) + 0e0 AS skewness, round(avg(power((l_extendedprice - mu) / sd, 4)) - 3, 6) AS kurtosis,
  round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem, m""")
def _(t):
    s = A.summary(t.table("lineitem"), "l_extendedprice", (0.05, 0.5, 0.99))
    return s.select("n", "low", "high", r6("skewness"), r6("kurtosis"), *[r6(c, 4) for c in ("mean", "std", "p05", "p50", "p99")])


PREDICT_SQL = ", pred AS (SELECT r.appid, r.playtime, r.voted_up, (s.positive + 5 * 0.6::DOUBLE) / (s.n + 5) AS p FROM reviews r JOIN review_stats s ON r.appid = s.appid)"


def predictions(t):
    p = (F.col("positive") + 5 * F.lit(0.6)) / (F.col("n") + 5)
    return t.reviews.join(t.review_stats.select("appid", p.alias("p")), "appid")


@check("calibration_by_playtime", PREDICT_SQL + """
, e AS (SELECT list_distinct(quantile_cont(playtime, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM pred)
SELECT CAST(len(list_filter(e, lambda x: x < playtime)) AS INTEGER) AS bin, count(*) AS n, round(avg(playtime), 6) AS mean_x, round(avg(p), 6) AS mean_predicted,
  round(avg(CAST(voted_up AS INTEGER)), 6) AS actual_rate FROM pred, e GROUP BY 1""")
def _(t):
    c = A.calibration(predictions(t), "playtime", "p", "voted_up")
    return c.select("bin", "n", r6("mean_x"), r6("mean_predicted"), r6("actual_rate"))


@check("classification_scores", PREDICT_SQL + """
, c AS (SELECT count(*) FILTER (p >= 0.66 AND voted_up) AS tp, count(*) FILTER (p >= 0.66 AND NOT voted_up) AS fp, count(*) FILTER (p < 0.66 AND voted_up) AS fn, count(*) AS n FROM pred)
SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round((SELECT corr(ln(playtime), CAST(voted_up AS INTEGER)) FROM pred), 6) + 0e0 AS corr_log_playtime FROM c""")
def _(t):
    p = predictions(t)
    corr = p.agg(F.corr(F.ln("playtime"), F.col("voted_up").cast("double")).alias("x")).scalar()
    scores = A.classification_scores(p, "p", "voted_up", 0.66).withColumn("corr_log_playtime", corr)
    return scores.select(*[r6(c) for c in scores.columns])


@check("classifier_labels", """
, j AS (SELECT n_chars > 800 AS yes, quality = 1 AS truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT count(*) FILTER (yes AND truth) AS tp, count(*) FILTER (yes AND NOT truth) AS fp, count(*) FILTER (NOT yes AND truth) AS fn, count(*) AS n FROM j)
SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c""")
def _(t):
    j = t.table("documents").join(t.table("labels"), "doc_id").select((F.col("n_chars") > 800).cast("double").alias("p"), (F.col("quality") == 1).alias("truth"))
    s = A.classification_scores(j, "p", "truth")
    return s.select(*[r6(c) for c in s.columns])


def chi_sql(x: str, degrees: int) -> str:
    terms = "1e0"
    for i in range(degrees // 2 - 1, 0, -1):
        terms = f"(1e0 + h / {i} * {terms})"
    return terms.join((f"(1e0 - exp(-({x} * {x} / 2)) * ", ")")).replace("h /", f"({x} * {x} / 2) /")


@check("length_distribution_fit", f"""
, l AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x * x))) * 4 AS v FROM vectors),
r AS (SELECT v, count(*) OVER (ORDER BY v) AS upto, count(*) OVER (PARTITION BY v) AS ties, count(*) OVER () AS n FROM l),
f AS (SELECT *, {chi_sql('v', 16)} AS cdf FROM r)
SELECT round(max(greatest(abs(upto / CAST(n AS DOUBLE) - cdf), abs((upto - ties) / CAST(n AS DOUBLE) - cdf))), 5) AS ks, max(n) AS n FROM f""")
def _(t):
    lengths = t.vectors.select((V.norm(F.col("vec")) * 4).alias("v"))
    return A.kolmogorov_smirnov(lengths, "v", A.chi_cdf(F.col("v"), 16)).select(r6("ks", 5), "n")


PAIRS_SQL = """
, n AS (SELECT count(*) AS n FROM vectors),
pairs AS (SELECT a.appid, b.appid AS appid2, list_dot_product(a.vec, b.vec) AS dot FROM vectors a, n JOIN vectors b ON (a.appid * 31 + 7) % n.n = b.appid WHERE a.appid <> b.appid)"""


def sampled_pairs(t):
    n = t.vectors.agg(F.count("*").alias("x")).scalar()
    numbered = t.vectors.withColumn("_n", n)
    return A.random_pairs(numbered, F.pmod(F.col("appid") * 31 + 7, F.col("_n")), F.col("appid"))


@check("similarity_natural_range", PAIRS_SQL + " SELECT round(avg(dot), 6) + 0e0 AS mean, round(stddev_pop(dot), 6) AS std, count(*) AS n FROM pairs")
def _(t):
    return A.natural_range(sampled_pairs(t), V.dot(F.col("vec"), F.col("vec2"))).select(r6("mean"), r6("std"), "n")


@check("length_moments", PAIRS_SQL + """
, l AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x * x))) * 4 AS v FROM vectors),
g AS (SELECT sqrt(2) * exp(lgamma(17 / 2.0::DOUBLE) - lgamma(8.0::DOUBLE)) AS m)
SELECT 'length' AS what, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(any_value(m), 6) AS law_mean, round(16 - any_value(m) * any_value(m), 6) AS law_variance FROM l, g
UNION ALL SELECT 'cosine', round(avg(dot), 6) + 0e0, round(var_pop(dot), 6), 0e0, round(1 / 64.0::DOUBLE, 6) FROM pairs""")
def _(t):
    lengths = t.vectors.select((V.norm(F.col("vec")) * 4).alias("v"))
    dots = sampled_pairs(t).select(V.dot(F.col("vec"), F.col("vec2")).alias("v"))
    both = A.theoretical_moments(lengths, "v", *A.chi_moments(16)).select(F.lit("length").alias("what"), "*").unionByName(
        A.theoretical_moments(dots, "v", 0.0, 1 / 64).select(F.lit("cosine").alias("what"), "*"))
    return both.select("what", *[r6(c) for c in ("mean", "variance", "law_mean", "law_variance")])


@check("divergence_natural_range", PAIRS_SQL.replace("list_dot_product(a.vec, b.vec) AS dot", "a.vec AS va, b.vec AS vb") + """
, d AS (SELECT list_transform(va, lambda x: abs(x) / list_sum(list_transform(va, lambda y: abs(y)))) AS p, list_transform(vb, lambda x: abs(x) / list_sum(list_transform(vb, lambda y: abs(y)))) AS q FROM pairs),
j AS (SELECT 0.5 * list_sum(list_transform(list_zip(p, q), lambda e: e[1] * ln((e[1] + 1e-10) / (0.5 * (e[1] + e[2] + 1e-10))) + e[2] * ln((e[2] + 1e-10) / (0.5 * (e[2] + e[1] + 1e-10))))) AS js FROM d)
SELECT round(avg(1 - sqrt(greatest(js, 0))), 6) AS mean, round(stddev_pop(1 - sqrt(greatest(js, 0))), 6) AS std, count(*) AS n FROM j""")
def _(t):
    def shares(v):
        size = F.transform(v, F.abs)
        return V.scale(size, F.lit(1.0) / V.array_sum(size))

    return A.natural_range(sampled_pairs(t), V.jensen_shannon_similarity(shares(F.col("vec")), shares(F.col("vec2")))).select(r6("mean"), r6("std"), "n")


@check("cosine_distribution_fit", PAIRS_SQL + f"""
, z AS (SELECT round(dot, 9) AS z, avg(round(dot, 9)) OVER () AS m, stddev_pop(round(dot, 9)) OVER () AS s FROM pairs),
r AS (SELECT z, m, s, (z - m) / s AS u, count(*) OVER (ORDER BY z) AS upto, count(*) OVER (PARTITION BY z) AS ties, count(*) OVER () AS n FROM z),
f AS (SELECT *, {normal.cdf_sql('u')} AS cdf FROM r)
SELECT round(max(greatest(abs(upto / CAST(n AS DOUBLE) - cdf), abs((upto - ties) / CAST(n AS DOUBLE) - cdf))), 5) AS ks, max(n) AS n FROM f""")
def _(t):
    from curatrix.operators.normalize import to_z
    dots = sampled_pairs(t).select(F.round(V.dot(F.col("vec"), F.col("vec2")), 9).alias("z"))
    return A.kolmogorov_smirnov(to_z(dots, {"z": "u"}), "u", normal.cdf("u")).select(r6("ks", 5), "n")


@check("variance_multiplier", DIM_SQL + """
, v AS (SELECT label < 5 AS low, dim, var_pop(x) AS v FROM dims GROUP BY 1, 2)
SELECT round(sqrt(avg(v) FILTER (low) / avg(v) FILTER (NOT low)), 6) AS multiplier FROM v""")
def _(t):
    return A.variance_multiplier(t.vectors.filter("label < 5"), t.vectors.filter("label >= 5")).select(r6("multiplier"))


@check("similarity_penalty", """
, l AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x * x))) * (1 + label) AS norm FROM vectors)
SELECT round(quantile_cont(norm, 0.95), 6) AS penalty, round(avg(norm), 6) AS mean_norm, round(var_samp(norm), 6) AS var_norm, count(*) AS n FROM l WHERE norm > 1e-6 AND norm <= 5""")
def _(t):
    norms = t.vectors.select((V.norm(F.col("vec")) * (1 + F.col("label"))).alias("norm"))
    return A.similarity_penalty(norms).select(r6("penalty"), r6("mean_norm"), r6("var_norm"), "n")


WELCH_SQL = """
, tot AS (SELECT user_id, count(*) AS tn, sum(CAST(rating AS DOUBLE)) AS ts, sum(CAST(rating * rating AS DOUBLE)) AS tq FROM ratings GROUP BY 1),
w AS (SELECT user_id, tag, count(*) AS n, sum(CAST(rating AS DOUBLE)) AS s, sum(CAST(rating * rating AS DOUBLE)) AS q FROM ratings r JOIN votes v ON r.appid = v.appid GROUP BY 1, 2),
b AS (SELECT w.*, tn - n AS m, s / n AS mw, (ts - s) / (tn - n) AS mo, (q - s * (s / n)) / (n - 1) / n AS a,
  (tq - q - (ts - s) * ((ts - s) / (tn - n))) / (tn - n - 1) / (tn - n) AS o FROM w JOIN tot ON w.user_id = tot.user_id WHERE n >= 5 AND tn - n >= 5),
eff AS (SELECT user_id, tag, n AS n_with, m AS n_without, mw AS mean_with, mo AS mean_without, mw - mo AS diff,
  CASE WHEN a + o > 1e-12 THEN (mw - mo) / sqrt(a + o) END AS t, CASE WHEN a + o > 1e-12 THEN (a + o) * (a + o) / (a * a / (n - 1) + o * o / (m - 1)) END AS df FROM b)"""


@check("tag_effects", WELCH_SQL + """
SELECT user_id, tag, n_with, n_without, round(mean_with, 6) AS mean_with, round(mean_without, 6) AS mean_without, round(diff, 6) + 0e0 AS diff, round(t, 5) + 0e0 AS t, round(df, 4) AS df FROM eff""")
def _(t):
    e = A.tag_effects(t.ratings, t.votes)
    return e.select("user_id", "tag", "n_with", "n_without", r6("mean_with"), r6("mean_without"), r6("diff"), r6("t", 5), r6("df", 4))


@check("significant_tag_effects")
def _(t):
    return A.significant_effects(A.tag_effects(t.ratings, t.votes))


@check("rating_density_by_tag", """
, r AS (SELECT tag, CAST(rating AS DOUBLE) AS v FROM ratings r JOIN votes v ON r.appid = v.appid), s AS (SELECT tag, count(*) AS n, greatest(0.5, 1.06 * power(sqrt(count(*)), -0.2)) AS h FROM r GROUP BY 1),
p AS (SELECT unnest(range(40)) * 10 / 39.0::DOUBLE AS x), c AS (SELECT tag, v, count(*) AS c FROM r GROUP BY 1, 2)
SELECT c.tag, x, round(sum(c * exp(-0.5 * power((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0e0 AS density FROM c JOIN s ON c.tag = s.tag CROSS JOIN p GROUP BY 1, 2""")
def _(t):
    tagged = t.ratings.join(t.votes.select("appid", "tag"), "appid").select("tag", F.col("rating").cast("double").alias("v"))
    return A.density(tagged, "v", ["tag"], [i * 10 / 39 for i in range(40)]).select("tag", "x", r6("density"))


@check("rating_density_without_tag", """
, r AS (SELECT tag, CAST(rating AS DOUBLE) AS v, count(*) AS c FROM ratings r JOIN votes v ON r.appid = v.appid GROUP BY 1, 2), e AS (SELECT CAST(rating AS DOUBLE) AS v, count(*) AS c FROM ratings GROUP BY 1),
o AS (SELECT t.tag, e.v, e.c - coalesce(r.c, 0) AS c FROM (SELECT DISTINCT tag FROM r) t CROSS JOIN e LEFT JOIN r ON r.tag = t.tag AND r.v = e.v),
s AS (SELECT tag, sum(c) AS n, greatest(0.5, 1.06 * power(sqrt(sum(c)), -0.2)) AS h FROM o GROUP BY 1), p AS (SELECT unnest(range(40)) * 10 / 39.0::DOUBLE AS x)
SELECT o.tag, x, round(sum(c * exp(-0.5 * power((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0e0 AS density FROM o JOIN s ON o.tag = s.tag CROSS JOIN p WHERE c > 0 GROUP BY 1, 2""")
def _(t):
    rated = t.ratings.select("appid", F.col("rating").cast("double").alias("v"))
    tagged = rated.join(t.votes.select("appid", "tag"), "appid").select("tag", "v")
    return A.complement_density(rated, tagged, "v", "tag", [i * 10 / 39 for i in range(40)]).select("tag", "x", r6("density"))


@check("price_density", """
, c AS (SELECT price, count(*) AS c FROM items WHERE price <= 960 GROUP BY 1), s AS (SELECT count(*) AS n, 0.05 * stddev_samp(price) AS h FROM items WHERE price <= 960),
p AS (SELECT 900 + unnest(range(121)) / 2.0::DOUBLE AS x)
SELECT x, round(sum(c * exp(-0.5 * power((x - price) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0e0 AS density FROM c, s, p GROUP BY 1""")
def _(t):
    priced = t.items.filter("price <= 960")
    h = priced.agg((F.stddev_samp("price") * 0.05).alias("x")).scalar()
    return A.density(priced, "price", [], [900 + i / 2 for i in range(121)], bandwidth=h).select("x", r6("density"))


@check("trend_lines", """
SELECT round(regr_slope(rating, log10(playtime)), 6) + 0e0 AS slope, round(regr_intercept(rating, log10(playtime)), 6) AS intercept,
  round(min(log10(playtime)), 6) AS x_min, round(max(log10(playtime)), 6) AS x_max FROM ratings WHERE playtime > 0""")
def _(t):
    out = A.trend(t.ratings.filter("playtime > 0"), F.log10("playtime"), F.col("rating").cast("double"))
    return out.select(*[r6(c) for c in out.columns])


@check("rating_anchors", f"""
, a AS (SELECT avg(positive / CAST(n AS DOUBLE)) AS a FROM catalogue WHERE n >= 30),
p AS (SELECT appid, greatest(1e-6, least(1 - 1e-6, (positive + 25 * a) / (n + 25))) AS p FROM review_stats, a),
q AS (SELECT appid, {normal.quantile_sql('p')} AS q FROM p), e AS (SELECT max(q) AS hi, min(q) AS lo FROM q),
b AS (SELECT hi + {normal.density_sql('hi')} / {normal.cdf_sql('hi')} AS top, lo - {normal.density_sql('lo')} / (1 - {normal.cdf_sql('lo')}) AS bottom FROM e)
SELECT (SELECT appid FROM q ORDER BY q DESC, appid LIMIT 1) AS best_appid, (SELECT appid FROM q ORDER BY q, appid LIMIT 1) AS worst_appid,
  round(10 / (top - bottom), 6) AS slope, round(-10 / (top - bottom) * bottom, 6) AS intercept FROM b""")
def _(t):
    rate = A.positive_rate(t.review_stats, 30).scalar()
    a = A.rating_anchors(t.review_stats, 25.0, rate)
    return a.select("best_appid", "worst_appid", r6("slope"), r6("intercept"))
