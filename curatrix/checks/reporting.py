"""Explanations, labels, topics, the item table end to end and validation."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from curatrix.checks.aggregation import DIM_SQL
from curatrix.checks.ranking import grid
from curatrix.checks.registry import check
from curatrix.checks.scalars import PRICE_SQL
from curatrix.checks.similarity import LABELS_SQL, features, topics
from curatrix.functions import text
from curatrix.operators import aggregates, explain, matrix, pairs, tags, toplists
from curatrix.operators.normalize import r6, to_z
from curatrix.plans import catalogue, validate

TAG_DIM_SQL = DIM_SQL + """
, td AS (SELECT o.tag, d.dim, corr(d.x, CAST(coalesce(votes, 0) AS DOUBLE)) AS r FROM (SELECT * FROM dims WHERE appid IN (SELECT appid FROM votes)) d CROSS JOIN tag_names o LEFT JOIN votes v ON v.appid = d.appid AND v.tag = o.tag GROUP BY 1, 2)"""


def tag_dimensions(t):
    """Correlation of every tag with every vector dimension, from one Gram matrix of both together."""
    t.keep("votes")
    names = tags.tag_list(t.votes)
    told = t.votes.join(t.vectors.select("appid"), "appid", "left_semi")
    both = tags.dense(told, names).join(t.vectors, "appid").select(F.concat("counts", "vec").alias("z"))
    k = len(names)
    order = F.array(*[F.lit(n) for n in names])
    c = matrix.correlations(both, "z", k + 64).filter((F.col("i") < k) & (F.col("j") >= k))
    return c.select(F.element_at(order, F.col("i") + 1).alias("tag"), (F.col("j") - k).alias("dim"), "r")


@check("tag_dimension_correlations", TAG_DIM_SQL + " SELECT tag, CAST(dim AS INTEGER) AS dim, round(r, 6) + 0e0 AS r FROM td")
def _(t):
    return tag_dimensions(t).select("tag", "dim", r6("r"))


def tag_weights(t):
    rows = tag_dimensions(t)
    return rows.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "r"))), lambda e: e["r"]).alias("vec"))


@check("dimension_tags", TAG_DIM_SQL + """
, c AS (SELECT tag, count(*) AS items FROM votes GROUP BY 1), s AS (SELECT td.*, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS side FROM td JOIN c ON td.tag = c.tag WHERE items >= 1000 AND r <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY dim, side ORDER BY abs(r) DESC, tag) AS rank FROM s) SELECT CAST(dim AS INTEGER) AS dim, side, tag, CAST(rank AS INTEGER) AS rank, round(r, 6) AS w FROM k WHERE rank <= 5""")
def _(t):
    counts = t.votes.groupBy("tag").agg(F.count("*").alias("items"))
    return explain.dimension_tags(tag_weights(t), counts, 5, 1000).select("dim", "side", "tag", "rank", r6("w"))


@check("strongest_dimensions", TAG_DIM_SQL + """
, q AS (SELECT vec FROM vectors ORDER BY appid LIMIT 1), e AS (SELECT i - 1 AS dim, vec[i] AS taste FROM q, range(1, 65) g(i)), top AS (SELECT * FROM e ORDER BY abs(taste) DESC, dim LIMIT 5),
k AS (SELECT td.dim, tag, r * taste AS c, row_number() OVER (PARTITION BY td.dim ORDER BY r * taste DESC, tag) AS rank FROM td JOIN top ON td.dim = top.dim)
SELECT CAST(dim AS INTEGER) AS dim, tag, CAST(rank AS INTEGER) AS rank, round(c, 6) + 0e0 AS contribution FROM k WHERE rank <= 5""")
def _(t):
    taste = [float(x) for x in t.vectors.orderBy("appid").first()["vec"]]
    return explain.strongest_dimensions(taste, tag_weights(t), 5, 5).select("dim", "tag", "rank", r6("contribution"))


@check("category_tags", TAG_DIM_SQL + """
, q AS (SELECT vec FROM vectors ORDER BY appid LIMIT 1), s AS (SELECT tag, sum(r * vec[dim + 1]) AS score FROM td, q GROUP BY 1) SELECT tag, round(score, 6) + 0e0 AS score FROM s ORDER BY s.score DESC, tag LIMIT 10""")
def _(t):
    category = [float(x) for x in t.vectors.orderBy("appid").first()["vec"]]
    return explain.category_tags(category, tag_dimensions(t), 10).select("tag", r6("score"))


@check("alias_tags", TAG_DIM_SQL + """
, n AS (SELECT tag, sqrt(sum(r * r)) AS l FROM td GROUP BY 1), p AS (SELECT a.tag AS s, b.tag AS o, sum(a.r * b.r) AS d FROM td a JOIN td b ON a.dim = b.dim AND a.tag <> b.tag GROUP BY 1, 2),
c AS (SELECT s, o, d / (x.l * y.l + 1e-9) AS sim FROM p JOIN n x ON x.tag = s JOIN n y ON y.tag = o), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, o) AS rank FROM c)
SELECT s AS tag, o AS partner, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0e0 AS similarity FROM k WHERE rank <= 5""")
def _(t):
    t.keep("votes")
    names = tags.tag_list(t.votes)
    order = F.array(*[F.lit(n) for n in names])
    rows = t.once("tag weights", lambda: tag_weights(t)).withColumn("appid", (F.array_position(order, F.col("tag"))).cast("long")).select("appid", "vec")
    near = pairs.neighbours(rows, rows, 5)
    at = lambda c: F.element_at(order, F.col(c).cast("int"))
    return near.select(at("seed").alias("tag"), at("appid").alias("partner"), "rank", r6("similarity"))


@check("taste_search", """
, q AS (SELECT vec AS q, sqrt(list_dot_product(vec, vec)) AS l FROM vectors ORDER BY appid LIMIT 1), m AS (SELECT avg(sqrt(list_dot_product(vec, vec))) AS m FROM vectors),
s AS (SELECT appid, list_dot_product(vec, q) / l / (sqrt(list_dot_product(vec, vec)) + 0.5) * m AS score FROM vectors, q, m) SELECT appid, round(score, 6) AS score FROM s ORDER BY s.score DESC, appid LIMIT 20""")
def _(t):
    from curatrix.functions import vectors as V
    taste = [float(x) for x in t.vectors.orderBy("appid").first()["vec"]]
    mean = t.vectors.agg(F.avg(V.norm(F.col("vec"))).alias("x")).scalar()
    return explain.search_by_taste(t.vectors, taste, 0.5, 20, mean).select("appid", r6("score"))


@check("ideal_tag_profile")
def _(t):
    names = tags.tag_list(t.votes)
    prior = {r["tag"]: r["share"] for r in aggregates.tag_prior(t.votes).collect()}
    g = [prior[n] for n in names]
    shaped = tags.transform_profiles(tags.smoothed_profiles(tags.dense(t.votes, names), g), g, "clr")
    _, _, second = matrix.moments(shaped, "vec", len(names))
    w = matrix.whitening_matrix(second)
    taste = np.linspace(1, -1, w.shape[1])
    return explain.ideal_profile(t.spark, [float(x) for x in taste], w, names, g)


def word_vectors(t):
    """A vector for each of the 3,000 most frequent words: the mean vector of the items whose number its documents carry."""
    tokens = t.table("documents").select(F.col("doc_id").alias("appid"), F.explode(F.array_distinct(text.words(F.col("text"), 3))).alias("word"))
    common = tokens.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(3000).select("word")
    rows = tokens.join(common, "word", "left_semi").join(t.vectors.select("appid", "vec"), "appid")
    return pairs.centroids(rows, "word")


@check("dimension_word_bags")
def _(t):
    return explain.label_dimensions(word_vectors(t), 64)


@check("dimension_word_pairs")
def _(t):
    words = t.once("words", lambda: word_vectors(t))
    opposite = explain.label_pairs(words).withColumn("form", F.lit("difference"))
    return opposite.unionByName(explain.label_pairs(words, difference=False).withColumn("form", F.lit("sum")))


@check("motivation_scores", DIM_SQL + """
, cent AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
uv AS (SELECT user_id, list(m ORDER BY dim) AS u FROM (SELECT user_id, dim, avg(x) AS m FROM ratings r JOIN dims d ON r.appid = d.appid GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, 'm' || label AS motive, round(1.5 * list_dot_product(u, c) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c, c)) + 1e-9), 6) + 0e0 AS score FROM uv CROSS JOIN cent""")
def _(t):
    users = pairs.centroids(t.ratings.join(t.vectors.select("appid", "vec"), "appid"), "user_id")
    motives = pairs.centroids(t.vectors, "label").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("motive"), "vec")
    return explain.motivation_scores(users, motives, {"vec": 1.5}).select("user_id", "motive", r6("score"))


@check("motives_of_topics_and_items", LABELS_SQL + """
, a AS (SELECT label AS topic, CASE WHEN list_dot_product(c, (SELECT vec FROM vectors ORDER BY appid LIMIT 1)) / sqrt((SELECT list_dot_product(vec, vec) FROM vectors ORDER BY appid LIMIT 1)) >=
  list_dot_product(c, (SELECT vec FROM vectors ORDER BY appid DESC LIMIT 1)) / sqrt((SELECT list_dot_product(vec, vec) FROM vectors ORDER BY appid DESC LIMIT 1)) THEN 'first' ELSE 'last' END AS motive FROM cent),
p AS (SELECT appid, motive, sum(e / t) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY appid) AS t FROM tex) x JOIN a ON x.label = a.topic GROUP BY 1, 2)
SELECT appid, motive, round(p, 6) AS p, arg_max(motive, p) OVER (PARTITION BY appid) AS lead FROM p""")
def _(t):
    centres = pairs.centroids(t.vectors, "label").select(F.col("label").cast("long").alias("topic"), "vec")
    ends = t.vectors.orderBy("appid").limit(1).select(F.lit("first").alias("motive"), "vec").unionByName(t.vectors.orderBy(F.desc("appid")).limit(1).select(F.lit("last").alias("motive"), "vec"))
    assigned = explain.topic_motives(centres, ends)
    return explain.item_motives(topics(t), assigned).select("appid", "motive", r6("p"), "lead")


@check("topic_clusters")
def _(t):
    return explain.topic_clusters(t.vectors, 10).select("appid", "topic")


@check("topic_leading_words", """
, w AS (SELECT source AS topic, unnest(regexp_extract_all(lower(text), '([\\p{L}]{3,})', 1)) AS word FROM documents), c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY 1, 2), pt AS (SELECT topic, sum(n) AS t FROM c GROUP BY 1),
pw AS (SELECT word, sum(n) AS f FROM c GROUP BY 1), s AS (SELECT c.topic, c.word, n / t * ln((SELECT avg(t) FROM pt) / f + 1) AS score FROM c JOIN pt ON c.topic = pt.topic JOIN pw ON c.word = pw.word),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, word) AS rank FROM s) SELECT topic, word, CAST(rank AS INTEGER) AS rank, round(score, 8) AS score FROM k WHERE rank <= 10""")
def _(t):
    words = t.table("documents").select(F.col("source").alias("topic"), F.explode(text.words(F.col("text"), 3)).alias("word"))
    return explain.topic_words(words, 10).select("topic", "word", "rank", r6("score", 8))


@check("topic_leading_items", LABELS_SQL + """
, k AS (SELECT appid, label, e / t AS p, row_number() OVER (PARTITION BY label ORDER BY round(e / t, 12) DESC, appid) AS rank FROM (SELECT *, sum(e) OVER (PARTITION BY appid) AS t FROM tex))
SELECT appid, label AS topic, CAST(rank AS INTEGER) AS rank, round(p, 6) AS p FROM k WHERE rank <= 10""")
def _(t):
    return explain.topic_items(topics(t), 10).select("appid", "topic", "rank", r6("p"))


@check("lexicon_tone", LABELS_SQL + """
, ts AS (SELECT n_name AS tag, n_nationkey % 5 + 1 AS s FROM nation WHERE n_nationkey < 15), tg AS (SELECT appid, sum(votes * s) / CAST(sum(votes) AS DOUBLE) AS t FROM votes v JOIN ts ON v.tag = ts.tag GROUP BY 1),
tp AS (SELECT appid, CASE WHEN sum(p) > 0.01 THEN sum(p * (label % 5 + 1)) / sum(p) END AS t FROM (SELECT appid, label, e / sum(e) OVER (PARTITION BY appid) AS p FROM tex) WHERE label < 5 GROUP BY 1)
SELECT v.appid, round(0.7 * coalesce(tg.t, 2.5) + 0.3 * coalesce(tp.t, 2.5), 6) AS tone_score FROM vectors v LEFT JOIN tg ON tg.appid = v.appid LEFT JOIN tp ON tp.appid = v.appid""")
def _(t):
    tag_scores = t.table("nation").filter("n_nationkey < 15").select(F.col("n_name").alias("tag"), (F.col("n_nationkey") % 5 + 1).alias("score"))
    topic_scores = t.spark.range(5).select(F.col("id").cast("int").alias("topic"), (F.col("id") % 5 + 1).alias("score"))
    return explain.tone_scores(t.votes, tag_scores, topics(t), topic_scores).select("appid", r6("tone_score"))


@check("tag_components")
def _(t):
    names = tags.tag_list(t.votes)
    weights = {r["tag"]: r["idf"] for r in tags.idf(tags.active_tags(t.votes)).collect()}
    loadings = explain.tag_components(tags.dense(t.votes, names), names, [weights.get(n, 1.0) for n in names])
    return loadings.unionByName(explain.component_of_tag(loadings, names[0]).withColumn("tag", F.lit("leading for " + names[0])))


@check("neighbourhood_by_taste")
def _(t):
    """The nearest hundred of each popular item, re-scored by taste weights."""
    rows = features(t)
    near = pairs.neighbours(rows, rows.orderBy(F.desc("n"), "appid").limit(20), 100)
    scored = near.drop("rank").join(to_z(rows, {"positive": "z"}).select("appid", "z", "difficulty_z"), "appid").withColumn(
        "score", F.col("similarity") * 2 + F.col("z") * 0.5 - F.col("difficulty_z") * 0.2)
    return toplists.top_k_by_group(scored, ["seed"], [F.desc("score"), F.asc("appid")], 10).select("seed", "appid", "rank", "score")


# ----------------------------------------------------------------------------- end to end

AS_OF = dt.date(1999, 1, 1)


def item_table(t):
    raw = t.raw_items.join(t.dated.select("appid", F.col("raw").alias("release_date")), "appid", "left").withColumns(
        {"positive": F.col("positive_text"), "negative": (F.col("size") / 7).cast("int").cast("string")})
    return catalogue.build_items(raw, t.reviews, AS_OF, ["size"])


@check("item_table", f"""
, pre AS (SELECT r.*, d.parsed, coalesce(TRY_CAST(replace(positive_text, ',', '') AS DOUBLE), 0) AS p0, CAST(trunc(size / 7.0) AS BIGINT) AS n0, {PRICE_SQL} AS pn FROM raw_items r LEFT JOIN parsed_dates d ON r.appid = d.appid WHERE NOT is_dlc AND name IS NOT NULL),
st AS (SELECT appid, count(*) FILTER (voted_up) AS p, count(*) FILTER (NOT voted_up) AS n, median(playtime) FILTER (voted_up) AS m FROM reviews GROUP BY 1),
j AS (SELECT pre.*, greatest(CAST(p0 AS BIGINT), coalesce(p, 0)) AS positive, greatest(n0, coalesce(n, 0)) AS negative, m, coalesce(p, 0) AS rc, CASE WHEN parsed > TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' ELSE parsed END AS dd FROM pre LEFT JOIN st ON pre.appid = st.appid),
mu AS (SELECT avg(ln(1 + m)) FILTER (rc > 0) AS mu FROM j), l AS (SELECT j.*, ln(1 + CAST(positive + negative AS DOUBLE)) AS lp, ln(1 + pn) AS lpr, (rc * ln(1 + coalesce(m, exp(mu) - 1)) + 1.159365 * mu) / (rc + 1.159365) AS ll FROM j, mu),
s AS (SELECT avg(lp) AS a1, stddev_pop(lp) AS b1, avg(lpr) AS a2, stddev_samp(lpr) AS b2, avg(ll) AS a3, stddev_pop(ll) AS b3, avg(epoch(dd)) AS a4, stddev_pop(epoch(dd)) AS b4 FROM l)
SELECT appid, name, positive, negative, pn AS price_numeric, round((lp - a1) / b1, 6) + 0e0 AS pop_z, round(coalesce((lpr - a2) / b2, 0), 6) + 0e0 AS price_z, round((ll - a3) / b3, 6) + 0e0 AS playtime_z, round(exp(ll) - 1, 5) AS estimated_playtime,
  round(coalesce((epoch(dd) - a4) / b4, 0), 6) + 0e0 AS date_z FROM l, s""")
def _(t):
    out = item_table(t)
    return out.select("appid", "name", "positive", "negative", "price_numeric", r6("pop_z"), r6("price_z"), r6("playtime_z"), r6("estimated_playtime", 5), r6("date_z"))


@check("build_validation", """
SELECT unnest(['items.distinct', 'reviews.rows', 'reviews.missing', 'reviews.unknown', 'vectors.rows', 'vectors.missing', 'vectors.unknown', 'grid.steps', 'grid.rows', 'constants.missing']) AS "check",
  unnest([i, i, 0, 0, i, 0, 0, 21, 21 * i, 0]) AS expected, unnest([i, s, i - s, 0, v, (SELECT count(*) FROM items WHERE appid NOT IN (SELECT appid FROM vectors)), (SELECT count(*) FROM vectors WHERE appid NOT IN (SELECT appid FROM items)), 21, 21 * s, 1]) AS actual,
  unnest([true, i = s, i = s, true, i = v, (SELECT count(*) FROM items WHERE appid NOT IN (SELECT appid FROM vectors)) = 0, (SELECT count(*) FROM vectors WHERE appid NOT IN (SELECT appid FROM items)) = 0, true, i = s, false]) AS ok
FROM (SELECT (SELECT count(*) FROM items) AS i, (SELECT count(*) FROM review_stats) AS s, (SELECT count(*) FROM vectors) AS v)""")
def _(t):
    constants = t.table("nation").select(F.col("n_name").alias("name"))
    return validate.validate(t.items, {"reviews": t.review_stats, "vectors": t.vectors}, grid(t), 21, constants, ["NATION_1", "penalty"])
