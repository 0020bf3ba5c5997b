"""Scans, joins, views and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curatrix.checks.registry import check
from curatrix.checks.scalars import FOLD_NAME_SQL, fold_title_sql
from curatrix.operators import joins, toplists
from curatrix.operators.normalize import r6
from curatrix.session import shared_folder
from curatrix.sources import readers, sinks

NOW = dt.datetime(1998, 6, 1)


@check("pruned_scan", "SELECT l_partkey AS appid, l_quantity AS playtime FROM lineitem WHERE l_quantity > 49")
def _(t):
    return t.table("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("appid"), F.col("l_quantity").alias("playtime"))


@check("keys_of_interest", "SELECT appid, order_id, line, playtime FROM reviews WHERE appid IN (SELECT appid FROM ratings WHERE rating = 10)")
def _(t):
    return readers.read_keys_of_interest(t.reviews, t.ratings.filter("rating = 10")).select("appid", "order_id", "line", "playtime")


@check("available_columns", "SELECT appid, name, 0.0::DOUBLE AS tone_z, 'unknown' AS developer FROM items")
def _(t):
    return readers.select_available(t.items, {"appid": None, "name": "", "tone_z": 0.0, "developer": "unknown"})


@check("preferred_stats", """
, a AS (SELECT appid, count(*) FILTER (voted_up) AS p, count(*) FILTER (NOT voted_up) AS q FROM reviews WHERE line = 1 GROUP BY 1),
b AS (SELECT appid, count(*) FILTER (voted_up) AS p, count(*) FILTER (NOT voted_up) AS q FROM reviews WHERE playtime < 40 GROUP BY 1)
SELECT i.appid, coalesce(CASE WHEN a.p + a.q > 0 THEN a.p ELSE b.p END, 0) AS positive, coalesce(CASE WHEN a.p + a.q > 0 THEN a.q ELSE b.q END, 0) AS negative
FROM items i LEFT JOIN a ON i.appid = a.appid LEFT JOIN b ON i.appid = b.appid""")
def _(t):
    def stats(df):
        return df.groupBy("appid").agg(F.count_if("voted_up").alias("positive"), F.count_if(~F.col("voted_up")).alias("negative"))

    return readers.preferred_stats(t.items.select("appid"), stats(t.reviews.filter("line = 1")), stats(t.reviews.filter("playtime < 40")))


@check("review_counts_repaired", """
SELECT appid, greatest(size, coalesce(positive, 0)) AS positive, greatest(size // 7, coalesce(negative, 0)) AS negative FROM catalogue""")
def _(t):
    official = t.items.select("appid", F.col("size").alias("positive"), F.expr("size div 7").alias("negative"))
    return joins.with_review_counts(official, t.review_stats)


@check("difficulty_fallback", """
, pred AS (SELECT appid, CAST(positive AS DOUBLE) / n * 10 AS d FROM review_stats WHERE n >= 30),
j AS (SELECT i.appid, coalesce(d, 5.0) AS d, i.genre <> 'SMALL' AS tagged FROM items i LEFT JOIN pred p ON i.appid = p.appid),
s AS (SELECT avg(d) AS m, stddev_pop(d) AS sd FROM j WHERE tagged)
SELECT appid, round(d, 6) AS difficulty_predicted, round((d - m) / sd, 6) + 0e0 AS difficulty_z FROM j, s""")
def _(t):
    from curatrix.operators.normalize import difficulty_z
    pred = t.review_stats.filter("n >= 30").select("appid", (F.col("positive").cast("double") / F.col("n") * 10).alias("difficulty_predicted"))
    out = difficulty_z(t.items.select("appid", "genre"), pred, F.col("genre") != "SMALL")
    return out.select("appid", r6("difficulty_predicted"), r6("difficulty_z"))


@check("library_items", "SELECT r.user_id, r.appid, 'mine' AS name, i.name AS name_global, r.playtime FROM ratings r JOIN items i ON r.appid = i.appid")
def _(t):
    library = t.ratings.select("user_id", "appid", F.lit("mine").alias("name"), "playtime")
    return joins.library_items(library, t.items.select("appid", "name"))


VIEWS_SQL = """
, labels AS (SELECT r.user_id, r.appid, i.name, CASE WHEN rating = 4 THEN 0 ELSE r.playtime END AS playtime, rating AS predicted_rating FROM ratings r JOIN items i ON r.appid = i.appid WHERE rating <> 9),
truth AS (SELECT user_id, appid, CASE WHEN rating % 3 = 0 THEN NULL ELSE rating + 0.5::DOUBLE END AS actual_rating, rating % 5 = 1 AS ignore,
  CASE WHEN rating IN (2, 9) THEN 'rated' WHEN rating = 7 THEN 'ignored' END AS status FROM ratings WHERE rating NOT IN (0, 3)),
own AS (SELECT l.user_id, l.appid, l.name, l.playtime, l.predicted_rating, coalesce(t.actual_rating, l.predicted_rating) AS actual_rating,
  coalesce(t.ignore, false) AS ignore, t.status FROM labels l LEFT JOIN truth t ON l.user_id = t.user_id AND l.appid = t.appid),
manual AS (SELECT t.user_id, t.appid, i.name, 0.0::DOUBLE AS playtime, 5 AS predicted_rating, t.actual_rating, t.ignore,
  coalesce(t.status, CASE WHEN t.ignore THEN 'ignored' ELSE 'rated' END) AS status, true AS is_manual
  FROM truth t JOIN items i ON t.appid = i.appid WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.user_id = t.user_id AND l.appid = t.appid)),
dates AS (SELECT appid, first_ts AS parsed_date, CASE WHEN appid % 10 = 3 THEN 'Coming Soon' ELSE '1995' END AS release_date FROM review_stats)
"""


def view_inputs(t):
    r = F.col("rating")
    labels = (t.ratings.filter(r != 9).join(t.items.select("appid", "name"), "appid")
              .select("user_id", "appid", "name", F.when(r == 4, 0.0).otherwise(F.col("playtime")).alias("playtime"), r.alias("predicted_rating")))
    truth = t.ratings.filter(~r.isin(0, 3)).select(
        "user_id", "appid", F.when(r % 3 != 0, r + 0.5).alias("actual_rating"), (r % 5 == 1).alias("ignore"),
        F.when(r.isin(2, 9), "rated").when(r == 7, "ignored").alias("status"))
    dated = t.review_stats.select("appid", F.col("first_ts").alias("parsed_date"),
                                  F.when(F.col("appid") % 10 == 3, "Coming Soon").otherwise("1995").alias("release_date"))
    return labels, truth, t.items.select("appid", "name").join(dated, "appid")


@check("verify_view", VIEWS_SQL + """
SELECT o.user_id, o.appid, o.name, playtime, predicted_rating, actual_rating, ignore,
  coalesce(status, CASE WHEN ignore THEN 'ignored' ELSE 'played' END) AS status, false AS is_manual FROM own o JOIN dates d ON o.appid = d.appid
WHERE playtime > 0 AND parsed_date <= TIMESTAMP '1998-06-01' AND NOT regexp_matches(lower(release_date), 'coming soon')
  AND coalesce(status, CASE WHEN ignore THEN 'ignored' ELSE 'played' END) <> 'ignored'
UNION ALL SELECT * FROM manual WHERE status <> 'ignored'""")
def _(t):
    return joins.verify_view(*view_inputs(t), NOW)


@check("catalogue_view", VIEWS_SQL + """
SELECT user_id, appid, name, playtime, predicted_rating, actual_rating, ignore, coalesce(status, CASE WHEN ignore THEN 'ignored' WHEN playtime > 0 THEN 'played' ELSE 'backlog' END) AS status,
  false AS is_manual FROM own UNION ALL SELECT * FROM manual""")
def _(t):
    return joins.catalogue_view(*view_inputs(t))


@check("manual_additions", VIEWS_SQL + "SELECT user_id, appid, name, actual_rating FROM manual")
def _(t):
    labels, truth, items = view_inputs(t)
    return joins.manual_additions(truth, labels, items).select("user_id", "appid", "name", "actual_rating")


@check("details_for_names", """SELECT appid, title, CAST(n AS BIGINT) AS raw_pop, mid_playtime / 60 AS raw_length FROM catalogue
WHERE title IN (SELECT title FROM catalogue GROUP BY title HAVING count(*) >= 2)""")
def _(t):
    repeated = t.items.groupBy("title").agg(F.count("*").alias("c")).filter("c >= 2").select("title")
    return toplists.details(t.catalogue, repeated, "title").select("appid", "title", "raw_pop", "raw_length")


@check("external_library_merge", """
, truth AS (SELECT user_id, appid, rating FROM ratings WHERE rating >= 5),
ext AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey AS appid FROM orders)
SELECT user_id, appid, CAST(rating AS DOUBLE) AS actual_rating, 'rated' AS status FROM truth
UNION ALL SELECT e.user_id, e.appid, 5.0, 'backlog' FROM ext e WHERE e.appid IN (SELECT appid FROM items)
  AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.user_id = e.user_id AND t.appid = e.appid)""")
def _(t):
    truth = t.ratings.filter("rating >= 5").select("user_id", "appid", F.col("rating").cast("double").alias("actual_rating"), F.lit("rated").alias("status"))
    external = t.table("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("appid"))
    return joins.merge_external_library(truth, external, t.items).drop("ignore")


@check("missing_from_system", """
SELECT o_orderkey AS appid, o_totalprice AS playtime FROM orders
WHERE o_orderkey NOT IN (SELECT appid FROM items) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 10)""")
def _(t):
    external = t.table("orders").select(F.col("o_orderkey").alias("appid"), F.col("o_totalprice").alias("playtime"))
    return joins.missing_from_system(external, t.items, t.reviews.filter("playtime >= 10").select(F.col("order_id").alias("appid")))


@check("status_changes", """
, old AS (SELECT user_id, appid, CASE WHEN rating < 5 THEN 'backlog' ELSE 'played' END AS status FROM ratings WHERE rating <> 8),
new AS (SELECT user_id, appid, CASE WHEN rating >= 3 THEN 'played' ELSE 'backlog' END AS status FROM ratings)
SELECT n.user_id, n.appid, o.status AS old_status, CASE WHEN o.status IS NULL THEN 'new' ELSE 'changed' END AS change
FROM new n LEFT JOIN old o ON n.user_id = o.user_id AND n.appid = o.appid WHERE n.status = 'played' AND o.status IS DISTINCT FROM 'played'""")
def _(t):
    r = F.col("rating")
    old = t.ratings.filter(r != 8).select("user_id", "appid", F.when(r < 5, "backlog").otherwise("played").alias("status"))
    new = t.ratings.select("user_id", "appid", F.when(r >= 3, "played").otherwise("backlog").alias("status"))
    return joins.status_changes(old, new)


TITLES_SQL = f"""
, ext AS (SELECT appid AS ext_id, CASE appid % 3 WHEN 0 THEN 'The ' || title || ': Remastered' WHEN 1 THEN upper(title) || '!' ELSE name || 's ' || size END AS title FROM items),
lt AS (SELECT {fold_title_sql('title')} AS l, min(ext_id) AS ext_id FROM ext GROUP BY 1),
rt AS (SELECT {fold_title_sql('title')} AS r, min(appid) AS appid, max(appid) AS last_appid FROM items GROUP BY 1)"""


def external_titles(t):
    k = F.col("appid")
    title = (F.when(k % 3 == 0, F.concat(F.lit("The "), "title", F.lit(": Remastered"))).when(k % 3 == 1, F.concat(F.upper("title"), F.lit("!")))
             .otherwise(F.concat("name", F.lit("s "), F.col("size").cast("string"))))
    return t.items.select(k.alias("ext_id"), title.alias("title")), t.items.select("appid", F.col("title").alias("name"))


@check("title_match_exact", TITLES_SQL + f"""
SELECT last_appid AS appid, min(title) AS title FROM ext JOIN rt ON {fold_title_sql('title')} = r GROUP BY 1""")
def _(t):
    return joins.match_titles(*external_titles(t))


@check("title_match_contained", TITLES_SQL + """
, p AS (SELECT *, least(length(l), length(r)) / CAST(greatest(length(l), length(r)) AS DOUBLE) AS ratio,
  CASE WHEN length(l) <= length(r) THEN l ELSE r END AS short FROM lt JOIN rt ON contains(l, r) OR contains(r, l)),
k AS (SELECT * FROM p WHERE ratio > 0.7 AND contains(short, ' ')
  AND list_sort(list_distinct(regexp_extract_all(l, '(\\d+)', 1))) = list_sort(list_distinct(regexp_extract_all(r, '(\\d+)', 1))))
SELECT ext_id, appid, round(ratio * 0.9, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY ratio DESC, appid) AS rn FROM k) WHERE rn = 1""")
def _(t):
    return joins.contained_titles(*external_titles(t)).select("ext_id", "appid", r6("confidence"))


@check("title_match_closest", TITLES_SQL + """
, p AS (SELECT ext_id, appid, 1.0::DOUBLE - levenshtein(l, r) / CAST(greatest(length(l), length(r)) AS DOUBLE) AS sim FROM lt CROSS JOIN rt
  WHERE abs(length(l) - length(r)) <= 4)
SELECT ext_id, appid, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY sim DESC, appid) AS rn FROM p WHERE sim >= 0.9 - 1e-12) WHERE rn = 1""")
def _(t):
    return joins.closest_titles(*external_titles(t)).select("ext_id", "appid", r6("similarity"))


@check("series_twins", """
, s AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(text), '([\\p{L}]{1,})', 1))) AS w, min(doc_id) AS id FROM documents GROUP BY 1),
q AS (SELECT * FROM s WHERE len(w) >= 2)
SELECT a.id AS left_id, b.id AS right_id, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM q a JOIN q b ON a.id < b.id
WHERE len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) / CAST(greatest(len(a.w), len(b.w)) AS DOUBLE) > 0.7""")
def _(t):
    return joins.series_twins(t.table("documents").select(F.col("doc_id").alias("appid"), F.col("text").alias("name")))


@check("curve_interpolation", """
, curve AS (SELECT CAST(size AS DOUBLE) AS cx, avg(price) AS cy FROM items WHERE size % 5 = 0 GROUP BY 1),
x AS (SELECT DISTINCT user_id, avg(rating) OVER (PARTITION BY user_id) * 6 AS x FROM ratings),
n AS (SELECT user_id, x, max(cx) FILTER (cx <= x) AS lo, min(cx) FILTER (cx >= x) AS hi FROM x CROSS JOIN curve GROUP BY 1, 2)
SELECT user_id, round(CASE WHEN lo IS NULL THEN h.cy WHEN hi IS NULL OR hi = lo THEN l.cy ELSE l.cy + (h.cy - l.cy) * (x - lo) / (hi - lo) END, 6) AS y
FROM n LEFT JOIN curve l ON lo = l.cx LEFT JOIN curve h ON hi = h.cx""")
def _(t):
    curve = t.items.filter("size % 5 = 0").select(F.col("size").cast("double").alias("cx"), F.col("price").alias("cy"))
    x = t.ratings.groupBy("user_id").agg((F.avg("rating") * 6).alias("x"))
    return joins.interpolate(x, "x", curve, "y").select("user_id", r6("y"))


@check("union_of_columns", """
SELECT appid, name, price, CAST(NULL AS DOUBLE) AS n FROM items UNION ALL SELECT appid, NULL, NULL, CAST(n AS DOUBLE) FROM review_stats""")
def _(t):
    return readers.union_columns(t.items.select("appid", "name", "price"), t.review_stats.select("appid", F.col("n").cast("double").alias("n")), order=["appid", "name", "price", "n"])


@check("id_sets", """
, a AS (SELECT DISTINCT appid FROM ratings WHERE rating = 10), b AS (SELECT DISTINCT appid FROM ratings WHERE rating = 0)
SELECT 'either' AS kind, appid FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only_best', appid FROM a WHERE appid NOT IN (SELECT appid FROM b)""")
def _(t):
    a, b = (t.ratings.filter(F.col("rating") == v).select("appid").distinct() for v in (10, 0))
    either = a.union(b).distinct().select(F.lit("either").alias("kind"), "appid")
    return either.unionByName(a.join(b, "appid", "left_anti").select(F.lit("only_best").alias("kind"), "appid"))


@check("tag_overlap", """
, s AS (SELECT appid, list(DISTINCT tag) AS tags FROM votes GROUP BY 1), n AS (SELECT list(n_name) FILTER (n_regionkey = 1) AS fam FROM nation)
SELECT appid, CAST(len(list_intersect(tags, fam)) AS INTEGER) AS shared, CAST(len(tags) + len(fam) - len(list_intersect(tags, fam)) AS INTEGER) AS joined FROM s, n""")
def _(t):
    family = t.table("nation").filter("n_regionkey = 1").agg(F.collect_set("n_name").alias("x")).scalar()
    sets = t.votes.groupBy("appid").agg(F.collect_set("tag").alias("tags")).withColumn("fam", family)
    return sets.select("appid", F.size(F.array_intersect("tags", "fam")).alias("shared"), F.size(F.array_union("tags", "fam")).alias("joined"))


@check("written_csv", "SELECT doc_id AS appid, text AS review_text, lang AS review_id FROM documents")
def _(t):
    path = shared_folder(t.spark, "csv")
    rows = t.table("documents").select(F.col("doc_id").alias("appid"), F.col("lang").alias("review_id"), F.col("text").alias("review_text"))
    sinks.write_csv(rows, path)
    return readers.read_csv(t.spark, path, "appid LONG, review_id STRING, review_text STRING").select("appid", "review_text", "review_id")


@check("written_items", "SELECT appid, name, title, price FROM items")
def _(t):
    path = shared_folder(t.spark, "items")
    sinks.write_items(t.items, path)
    return t.spark.read.parquet(path).select("appid", "name", "title", "price")


@check("written_vectors", "SELECT appid, CAST(i - 1 AS INTEGER) AS dim, round(vec[i], 6) + 0e0 AS x FROM vectors, range(1, 65) g(i)")
def _(t):
    path = shared_folder(t.spark, "vectors")
    sinks.write_vectors(t.vectors, path)
    return sinks.read_vectors(t.spark, path).select("appid", F.posexplode("vec").alias("dim", "x")).select("appid", "dim", r6("x"))


@check("appended_reviews", "SELECT appid, order_id, line FROM reviews WHERE voted_up UNION ALL SELECT appid, order_id, line FROM reviews WHERE NOT voted_up")
def _(t):
    path = shared_folder(t.spark, "appended")
    rows = t.reviews.select("appid", "order_id", "line", "voted_up")
    sinks.append_rows(rows.filter("voted_up"), path)
    sinks.append_rows(rows.filter("NOT voted_up"), path)
    return t.spark.read.parquet(path).select("appid", "order_id", "line")
