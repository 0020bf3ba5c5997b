"""Vector similarity, neighbours and the seed kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.checks.aggregation import DIM_SQL
from curatrix.checks.registry import check
from curatrix.functions import vectors as V
from curatrix.operators import kernel as K
from curatrix.operators import matrix, pairs, tags
from curatrix.operators.normalize import r6, to_z

WEIGHTS = {"AFRICA": 4.0, "AMERICA": 8.0, "ASIA": 15.0, "EUROPE": 6.0}
FLAT, DEEP, CLASHES = ("NATION_0", "NATION_3"), ("NATION_5", "NATION_6"), (("AFRICA", "EUROPE"), ("EUROPE", "AFRICA"))


def taxonomy(t) -> K.Taxonomy:
    rows = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # 25 rows
    groups: dict[str, tuple[str, ...]] = {}
    for r in sorted(rows):
        groups[r["r_name"]] = (*groups.get(r["r_name"], ()), r["n_name"])
    return K.Taxonomy(groups=groups, weights=WEIGHTS, structural=("ASIA",), cognitive=("AMERICA",), semi=("EUROPE",),
                      flat_view=FLAT, deep_view=DEEP, clashes=CLASHES)


LABELS_SQL = DIM_SQL + """
, cent AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
tsim AS (SELECT appid, c.label, list_dot_product(vec, c) AS s FROM vectors CROSS JOIN cent c),
tex AS (SELECT appid, label, exp((s - max(s) OVER (PARTITION BY appid)) / 0.2) AS e FROM tsim),
topic AS (SELECT appid, list(e / t ORDER BY label) AS topics FROM (SELECT *, sum(e) OVER (PARTITION BY appid) AS t FROM tex) GROUP BY 1)"""
FEATURES_SQL = LABELS_SQL + """
, act AS (SELECT appid, tag FROM (SELECT *, max(votes) OVER (PARTITION BY appid) AS top FROM votes) WHERE votes / CAST(top AS DOUBLE) > 0.5),
prof AS (SELECT v.appid, list(CAST(coalesce(votes, 0) AS DOUBLE) ORDER BY n_name) AS verbs FROM vectors v CROSS JOIN nation LEFT JOIN votes o ON o.appid = v.appid AND o.tag = n_name GROUP BY 1),
ts AS (SELECT appid, list(tag) AS tag_set, list(DISTINCT r_name) AS groups FROM act JOIN nation ON tag = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
f0 AS (SELECT v.appid, c.title AS name, v.vec, verbs, topics, tag_set, groups, CAST(c.size AS DOUBLE) AS size, CAST(c.n AS DOUBLE) AS n, c.price, c.positive, c.negative FROM vectors v JOIN catalogue c ON v.appid = c.appid
  JOIN prof p ON v.appid = p.appid JOIN topic o ON v.appid = o.appid JOIN ts ON ts.appid = v.appid),
fz AS (SELECT avg(size) AS a, stddev_pop(size) AS b, avg(n) AS c, stddev_pop(n) AS d FROM f0), feat AS (SELECT f0.*, (size - a) / b AS dz, (n - c) / d AS tz FROM f0, fz)"""


def topics(t):
    centres = pairs.centroids(t.vectors, "label").withColumnRenamed("label", "topic")
    return pairs.topic_distributions(t.vectors, centres)


def features(t):
    return t.once("features", lambda: build_features(t))


def build_features(t):
    """Items with a vector: everything the kernel needs."""
    t.keep("votes")
    soul = K.soul_tags(t.votes, 0.5)
    sets = soul.groupBy("appid").agg(F.collect_set("tag").alias("tag_set")).join(
        K.item_groups(soul, taxonomy(t)).groupBy("appid").agg(F.collect_set("group").alias("groups")), "appid")
    verbs = tags.dense(t.votes, tags.tag_list(t.votes), target="verbs")
    base = (t.vectors.select("appid", "vec").join(t.catalogue.select("appid", F.col("title").alias("name"), "size", "n", "price", "positive", "negative"), "appid")
            .join(verbs, "appid").join(topics(t), "appid").join(sets, "appid"))
    return to_z(t.once("untold features", lambda: base), {"size": "difficulty_z", "n": "tone_z"})


@check("cosine_forms", DIM_SQL + """
, q AS (SELECT list(m ORDER BY dim) AS q FROM (SELECT dim, avg(x) AS m FROM dims WHERE label = 3 GROUP BY 1)),
d AS (SELECT appid, list_dot_product(vec, q) AS d, sqrt(list_dot_product(vec, vec)) AS a, sqrt(list_dot_product(q, q)) AS b FROM vectors, q)
SELECT appid, round(d / (a * b + 1e-9), 6) + 0e0 AS cosine, round(d / (a * b + 0.5), 6) + 0e0 AS penalized, round(d / (a + 0.1) * 2, 6) + 0e0 AS one_sided FROM d""")
def _(t):
    q = pairs.centroids(t.vectors.filter("label = 3"), "label").select("vec").scalar()
    rows = t.vectors.withColumn("q", q)
    v, w = F.col("vec"), F.col("q")
    out = rows.select("appid", V.cosine(v, w).alias("cosine"), V.penalized_cosine(v, w, 0.5).alias("penalized"), V.one_sided_cosine(v, w, 0.1, 2.0).alias("one_sided"))
    return out.select("appid", r6("cosine"), r6("penalized"), r6("one_sided"))


SEED_SQL = ", pop AS (SELECT v.appid FROM vectors v JOIN review_stats s ON v.appid = s.appid ORDER BY n DESC, v.appid LIMIT {k})"


def popular(t, k):
    return t.vectors.join(t.review_stats.select("appid", "n"), "appid").orderBy(F.desc("n"), "appid").limit(k)


NEAR_SQL = SEED_SQL.format(k=20) + """
, d AS (SELECT s.appid AS seed, c.appid, list_dot_product(s.vec, c.vec) / (sqrt(list_dot_product(s.vec, s.vec)) * sqrt(list_dot_product(c.vec, c.vec)) + 0.5) AS sim
  FROM vectors s JOIN pop ON s.appid = pop.appid JOIN vectors c ON c.appid <> s.appid),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, appid) AS rank FROM d)"""


@check("nearest_to_popular", NEAR_SQL + " SELECT seed, appid, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0e0 AS similarity FROM r WHERE rank <= 5")
def _(t):
    return pairs.neighbours(t.vectors, popular(t, 20), 5, penalty=0.5).select("seed", "appid", "rank", r6("similarity"))


@check("nearest_of_all", """
, d AS (SELECT s.appid AS seed, c.appid, list_dot_product(s.vec, c.vec) AS sim FROM vectors s JOIN vectors c ON c.appid <> s.appid), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, appid) AS rank FROM d)
SELECT seed, appid, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0e0 AS similarity FROM r WHERE rank <= 10""")
def _(t):
    return pairs.neighbours(t.vectors, t.vectors, 10, "dot").select("seed", "appid", "rank", r6("similarity"))


@check("similarity_ladder", NEAR_SQL + """
SELECT seed, round(max(sim) FILTER (rank = 1), 6) AS s1, round(max(sim) FILTER (rank = 10), 6) AS s10, round(max(sim) FILTER (rank = 50), 6) AS s50, round(max(sim) FILTER (rank = 100), 6) + 0e0 AS s100,
  round(max(sim) FILTER (rank = 1) - max(sim) FILTER (rank = 100), 6) AS drop FROM r GROUP BY 1""")
def _(t):
    out = pairs.similarity_ladder(pairs.neighbours(t.vectors, popular(t, 20), 100, penalty=0.5))
    return out.select("seed", *[r6(c) for c in ("s1", "s10", "s50", "s100", "drop")])


@check("centroid_vectors", DIM_SQL + """
, m AS (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT m.label, CAST(dim AS INTEGER) AS dim, round(m / (n + 1e-9), 6) + 0e0 AS x FROM m JOIN n ON m.label = n.label""")
def _(t):
    return pairs.centroids(t.vectors, "label", normalize="l2").select("label", F.posexplode("vec").alias("dim", "x")).select("label", "dim", r6("x"))


@check("topic_assignment", LABELS_SQL + " SELECT appid, CAST(i - 1 AS INTEGER) AS topic, round(topics[i], 6) AS p FROM topic, range(1, 11) g(i)")
def _(t):
    return topics(t).select("appid", F.posexplode("topics").alias("topic", "p")).select("appid", "topic", r6("p"))


@check("jensen_shannon_neighbours", LABELS_SQL + SEED_SQL.format(k=20) + """
, z AS (SELECT s.appid AS seed, c.appid, unnest(s.topics) AS p, unnest(c.topics) AS q FROM topic s JOIN pop ON pop.appid = s.appid JOIN topic c ON c.appid <> s.appid),
j AS (SELECT seed, appid, 1 - sqrt(greatest(0.5 * sum(p * ln((p + 1e-10) / (0.5 * (p + q + 1e-10))) + q * ln((q + 1e-10) / (0.5 * (p + q + 1e-10)))), 0)) AS sim FROM z GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, appid) AS rank FROM j)
SELECT seed, appid, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0e0 AS similarity FROM r WHERE rank <= 10""")
def _(t):
    rows = topics(t)
    return pairs.neighbours(rows, rows.join(popular(t, 20).select("appid"), "appid", "left_semi"), 10, "jsd", vector="topics").select("seed", "appid", "rank", r6("similarity"))


@check("prompt_search", LABELS_SQL + """
, q AS (SELECT vec AS q FROM vectors ORDER BY appid DESC LIMIT 1), s AS (SELECT appid, list_dot_product(vec, q) / (sqrt(list_dot_product(vec, vec)) + 0.1) * 2 AS text_sim FROM vectors, q)
, qe AS (SELECT label, exp((list_dot_product(c, q) - max(list_dot_product(c, q)) OVER ()) / 0.05) AS e FROM cent, q), qp AS (SELECT label, e / sum(e) OVER () AS p FROM qe),
tp AS (SELECT appid, label, e / sum(e) OVER (PARTITION BY appid) AS q FROM tex),
j AS (SELECT appid, (1 - sqrt(greatest(0.5 * sum(p * ln((p + 1e-10) / (0.5 * (p + q + 1e-10))) + q * ln((q + 1e-10) / (0.5 * (p + q + 1e-10)))), 0)) - 0.84609) / (0.03022 + 1e-9) AS topic_sim
  FROM tp JOIN qp ON tp.label = qp.label GROUP BY 1)
SELECT s.appid, round(text_sim, 6) + 0e0 AS text_sim, round(topic_sim, 4) + 0e0 AS topic_sim FROM s JOIN j ON s.appid = j.appid ORDER BY text_sim + topic_sim DESC, s.appid LIMIT 50""")
def _(t):
    prompt = [float(x) for x in t.vectors.orderBy(F.desc("appid")).first()["vec"]]  # stands for an encoded prompt
    centres = pairs.centroids(t.vectors, "label").withColumnRenamed("label", "topic")
    q = F.array(*[F.lit(x) for x in prompt])
    sims = centres.orderBy("topic").select("topic", V.dot(F.col("vec"), q).alias("s"))
    dist = V.softmax(F.transform(F.array_sort(F.collect_list(F.struct("topic", "s"))), lambda e: e["s"]), 0.05)
    rows = t.vectors.join(topics(t), "appid").withColumn("qp", sims.agg(dist.alias("x")).scalar())
    out = rows.select("appid", V.one_sided_cosine(F.col("vec"), q, 0.1, 2.0).alias("text_sim"),
                      V.jensen_shannon_similarity(F.col("qp"), F.col("topics"), 0.84609, 0.03022).alias("topic_sim"))
    top = out.orderBy(F.desc(F.col("text_sim") + F.col("topic_sim")), "appid").limit(50)
    return top.select("appid", r6("text_sim"), r6("topic_sim", 4))


ONE_SEED_SQL = FEATURES_SQL + ", s1 AS (SELECT verbs AS sv FROM feat ORDER BY n DESC, appid LIMIT 1), z AS (SELECT f.appid, unnest(verbs) AS a, unnest(sv) AS b FROM feat f, s1)"


@check("set_similarity_forms", ONE_SEED_SQL + """
, m AS (SELECT appid, sum(least(a, b)) AS i, sum(greatest(a, b)) AS u, sum(a) AS ca, sum(b) AS cb FROM z GROUP BY 1)
SELECT appid, round(i / (u + 1e-9), 6) AS jaccard, round(i / (i + 0.1 * (u - i)), 6) AS soft_jaccard, round(2 * i / (ca + cb), 6) AS dice, round(i / least(ca, cb), 6) AS inclusion,
  round(i / least(ca, cb) - 0.05 * abs(ca - cb) / greatest(ca, cb), 6) + 0e0 AS fuzzy_inclusion FROM m""")
def _(t):
    rows = features(t)
    seed = rows.orderBy(F.desc("n"), "appid").limit(1).select("verbs").scalar()
    sets = rows.select("appid", "verbs").withColumn("s", seed)
    out = sets.select("appid", *K.set_similarities(F.col("verbs"), F.col("s")))
    return out.select("appid", *[r6(c) for c in out.columns[1:]])


@check("axis_projection", DIM_SQL + """
, ax AS (SELECT dim, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS d FROM dims GROUP BY 1), n AS (SELECT sqrt(sum(d * d)) + 1e-9 AS n FROM ax),
p AS (SELECT appid, sum(x * d) / any_value(n) AS p FROM dims JOIN ax ON dims.dim = ax.dim CROSS JOIN n GROUP BY 1), s AS (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM p)
SELECT appid, round((p - m) / sd, 6) + 0e0 AS tone_z FROM p, s""")
def _(t):
    rows = pairs.project_on_axis(t.vectors, t.vectors.filter("label = 0"), t.vectors.filter("label = 1"))
    return to_z(rows, {"projection": "tone_z"}).select("appid", r6("tone_z"))


@check("diverse_seeds")
def _(t):
    return pairs.diverse_seeds(t.vectors.join(t.review_stats.select("appid", "n"), "appid")).select("rank", "appid", "n")


@check("whitened_vectors")
def _(t):
    return matrix.whiten(t.vectors, "vec", 64, unit_length=True).select("appid", F.posexplode("white").alias("dim", "x"))


SEED_KERNEL_SQL = FEATURES_SQL + f"""
, sd AS (SELECT appid, name, vec, verbs, topics, dz, tz FROM feat ORDER BY n DESC, appid LIMIT 2),
mv AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(vec[i]) AS m FROM sd, range(1, 65) g(i) GROUP BY 1)), mb AS (SELECT list(m ORDER BY i) AS vb FROM (SELECT i, avg(verbs[i]) AS m FROM sd, range(1, 26) g(i) GROUP BY 1)),
mt AS (SELECT list(m / (s + 1e-9) ORDER BY i) AS tp FROM (SELECT i, m, sum(m) OVER () AS s FROM (SELECT i, avg(topics[i]) AS m FROM sd, range(1, 11) g(i) GROUP BY 1))),
stag AS (SELECT DISTINCT tag FROM act WHERE appid IN (SELECT appid FROM sd)), sgr AS (SELECT list(DISTINCT r_name) AS sg FROM stag JOIN nation ON tag = n_name JOIN region ON n_regionkey = r_regionkey),
stg AS (SELECT list(tag) AS st FROM stag), cog AS (SELECT list(tag) AS ct FROM stag JOIN nation ON tag = n_name JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'),
seed AS (SELECT m, sqrt(list_dot_product(m, m)) AS sn, vb, tp, coalesce(sg, []) AS sg, coalesce(st, []) AS st, coalesce(ct, []) AS ct, (SELECT avg(dz) FROM sd) AS sdz, (SELECT avg(tz) FROM sd) AS stz,
  (SELECT string_agg(w, '|') FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM sd) WHERE length(w) > 3) AS words FROM mv, mb, mt, sgr, stg, cog),
k1 AS (SELECT f.appid, f.name, tag_set, groups, sg, st, ct, words, list_dot_product(vec, m) / (sn + 1e-9) / (sqrt(list_dot_product(vec, vec)) + 0.1) / (sn + 0.1) AS theme, greatest(0, least(1, list_dot_product(topics, tp))) AS topic_sim,
  exp(-0.5 * power((dz - sdz) / 3, 2)) AS difficulty, exp(-0.5 * power((tz - stz) / 3, 2)) AS tone,
  list_sum([least(verbs[i], vb[i]) for i in range(1, 26)]) / (list_sum([greatest(verbs[i], vb[i]) for i in range(1, 26)]) + 1e-9) AS mechanical, len(list_intersect(tag_set, ct)) > 0 AS soul FROM feat f, seed),
w AS (SELECT r_name AS g, CASE r_name WHEN 'AFRICA' THEN 4.0::DOUBLE WHEN 'AMERICA' THEN 8.0 WHEN 'ASIA' THEN 15.0 WHEN 'EUROPE' THEN 6.0 ELSE 1.0 END AS w FROM region),
gw AS (SELECT appid, sum(CASE WHEN list_contains(groups, g) AND list_contains(sg, g) THEN w ELSE 0 END) AS inter, sum(CASE WHEN list_contains(sg, g) THEN w WHEN g IN ('ASIA', 'EUROPE') AND list_contains(groups, g) THEN w ELSE 0 END) AS uni FROM k1, w GROUP BY 1),
k2 AS (SELECT k1.*, greatest(inter / (uni + 1e-9), CASE WHEN soul THEN 0.35 ELSE 0 END) AS identity, theme * (1 + 0.5 * topic_sim) AS vibe, theme > 0.35 OR topic_sim > 0.6 AS shield, list_contains(sg, 'ASIA') AS struct FROM k1 JOIN gw ON k1.appid = gw.appid),
k3 AS (SELECT *, CASE WHEN theme < CASE WHEN struct OR identity > 0.8 OR mechanical > 0.6 THEN 0 ELSE 0.05 END AND NOT shield THEN 0.001
  ELSE mechanical * power(identity, CASE WHEN shield OR soul OR identity > 0.8 OR struct THEN 1 ELSE 2 END) * vibe * tone * difficulty END AS gated,
  CASE WHEN identity > 0.4 THEN 2.0 ELSE 1.0 END AS boost, list_has_any(st, ['NATION_0', 'NATION_3']) AS flat, list_has_any(st, ['NATION_5', 'NATION_6']) AS deep FROM k2),
k4 AS (SELECT *, CASE WHEN flat = deep OR shield OR soul OR list_has_any(tag_set, CASE WHEN flat THEN ['NATION_0', 'NATION_3'] ELSE ['NATION_5', 'NATION_6'] END) THEN 1 ELSE 1 - 0.9 / (boost * 1.5) END AS view_veto,
  CASE WHEN len(sg) > 0 AND NOT list_contains(sg, 'ASIA') AND NOT shield AND list_contains(groups, 'ASIA') THEN 1 - 0.95 / boost ELSE 1 END
  * CASE WHEN len(sg) > 0 AND NOT list_contains(sg, 'EUROPE') AND NOT shield AND list_contains(groups, 'EUROPE') THEN 1 - 0.6 / boost ELSE 1 END AS protect,
  CASE WHEN list_contains(sg, 'AFRICA') AND NOT list_contains(sg, 'EUROPE') AND NOT shield AND list_contains(groups, 'EUROPE') THEN 1 - 0.5 / boost ELSE 1 END
  * CASE WHEN list_contains(sg, 'EUROPE') AND NOT list_contains(sg, 'AFRICA') AND NOT shield AND list_contains(groups, 'AFRICA') THEN 1 - 0.5 / boost ELSE 1 END AS clash,
  regexp_matches(lower(name), words) AND NOT regexp_matches(lower(name), 'remake|definitive edition|enhanced|special edition|remaster|bundle|goty|gold edition') AS hijack FROM k3),
kernel AS (SELECT *, greatest(0, gated * view_veto * protect * clash * CASE WHEN hijack AND identity < 0.3 AND NOT shield THEN 1e-4 ELSE 1 END) AS kernel FROM k4)"""


def merged_seed(t, rows):
    ids = [r["appid"] for r in rows.orderBy(F.desc("n"), "appid").select("appid").limit(2).collect()]
    return K.merge_seed(rows, ids, K.soul_tags(t.votes, 0.5), taxonomy(t))


def with_kernel(t):
    rows = features(t)
    return K.seed_kernel(rows, merged_seed(t, rows), taxonomy(t))


@check("seed_kernel", SEED_KERNEL_SQL + """
SELECT appid, round(kernel, 7) + 0e0 AS kernel, round(identity, 6) AS identity, round(mechanical, 6) AS mechanical, round(vibe, 6) + 0e0 AS vibe, round(theme, 6) + 0e0 AS theme, round(tone, 6) AS tone, round(difficulty, 6) AS difficulty FROM kernel""")
def _(t):
    out = with_kernel(t)
    return out.select("appid", r6("kernel", 7), *[r6(c) for c in ("identity", "mechanical", "vibe", "theme", "tone", "difficulty")])


@check("kernel_vetoes", SEED_KERNEL_SQL + " SELECT appid, round(CAST(view_veto AS DOUBLE), 6) AS view_veto, round(CAST(protect AS DOUBLE), 6) AS protection, round(CAST(clash AS DOUBLE), 6) AS clash, hijack FROM k4")
def _(t):
    rows, tax = features(t), taxonomy(t)
    seed = merged_seed(t, rows)
    out = K.components(rows, seed, tax).select("appid", K.view_veto(seed, tax).alias("view_veto"), K.identity_protection(seed, tax).alias("protection"),
                                               K.thematic_clash(seed, tax).alias("clash"), "hijack")
    return out.select("appid", r6("view_veto"), r6("protection"), r6("clash"), "hijack")


@check("seed_kernel_pool", SEED_KERNEL_SQL + " SELECT appid, round(kernel, 7) AS similarity FROM kernel WHERE kernel > 0")
def _(t):
    return with_kernel(t).filter("kernel > 0").select("appid", F.col("kernel").alias("similarity")).select("appid", r6("similarity", 7))


@check("shared_tag_rescue", SEED_KERNEL_SQL + """
, rescued AS (SELECT appid, kernel + CASE WHEN kernel > 0.02 THEN 0.1 * len(list_intersect(tag_set, list_intersect(st, ['NATION_1', 'NATION_4', 'NATION_9', 'NATION_14']))) ELSE 0 END AS score FROM kernel)
SELECT appid, round(score, 7) AS score FROM rescued ORDER BY score DESC, appid LIMIT 20""")
def _(t):
    rows = features(t)
    seed = merged_seed(t, rows)
    out = K.rescue_shared(K.seed_kernel(rows, seed, taxonomy(t)), seed.tags, ["NATION_1", "NATION_4", "NATION_9", "NATION_14"])
    return out.orderBy(F.desc("kernel"), "appid").limit(20).select("appid", F.col("kernel").alias("score")).select("appid", r6("score", 7))


@check("identity_groups", FEATURES_SQL + " SELECT appid, unnest(groups) AS \"group\" FROM ts")
def _(t):
    return K.item_groups(K.soul_tags(t.votes, 0.5), taxonomy(t))


PAIR_KERNEL_SQL = FEATURES_SQL + """
, w AS (SELECT r_name AS g, CASE r_name WHEN 'AFRICA' THEN 4.0::DOUBLE WHEN 'AMERICA' THEN 8.0 WHEN 'ASIA' THEN 15.0 WHEN 'EUROPE' THEN 6.0 ELSE 1.0 END AS w FROM region),
gs AS (SELECT appid, sum(w) AS gw FROM feat, w WHERE list_contains(groups, g) GROUP BY 1)"""
PAIR_VALUE_SQL = """
, pr AS (SELECT {keys}, list_sum([CASE g WHEN 'AFRICA' THEN 4.0 WHEN 'AMERICA' THEN 8.0 WHEN 'ASIA' THEN 15.0 WHEN 'EUROPE' THEN 6.0 ELSE 1.0 END for g in list_intersect(a.groups, b.groups)]) AS inter, ga.gw AS wa, gb.gw AS wb,
  list_sum([least(a.verbs[i], b.verbs[i]) for i in range(1, 26)]) / (list_sum([greatest(a.verbs[i], b.verbs[i]) for i in range(1, 26)]) + 1e-9) AS mech,
  list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) + 0.1) / (sqrt(list_dot_product(b.vec, b.vec)) + 0.1) AS theme, greatest(0, least(1, list_dot_product(a.topics, b.topics))) AS topic,
  exp(-0.5 * power((a.dz - b.dz) / 3, 2)) * exp(-0.5 * power((a.tz - b.tz) / 3, 2)) AS near FROM {source}),
pk AS (SELECT *, theme > 0.35 OR topic > 0.6 AS shield, coalesce(inter, 0) / (wa + wb - coalesce(inter, 0) + 1e-9) AS ident FROM pr),
pv AS (SELECT *, greatest(0, CASE WHEN theme < 0.05 AND NOT shield AND NOT mech > 0.6 THEN 0.001 ELSE mech * power(ident, CASE WHEN shield THEN 1 ELSE 2 END) * theme * (1 + 0.5 * topic) * near END) AS k FROM pk)"""


@check("pairwise_kernel", PAIR_KERNEL_SQL + ", sd AS (SELECT * FROM feat ORDER BY n DESC, appid LIMIT 20)" + PAIR_VALUE_SQL.format(
    keys="a.appid, b.appid AS seed", source="feat a CROSS JOIN sd b JOIN gs ga ON ga.appid = a.appid JOIN gs gb ON gb.appid = b.appid") + " SELECT appid, seed, round(k, 7) AS kernel FROM pv")
def _(t):
    rows = features(t)
    return K.pairwise_kernel(rows, rows.orderBy(F.desc("n"), "appid").limit(20), taxonomy(t)).select("appid", "seed", r6("kernel", 7))


@check("labelled_pair_results", PAIR_KERNEL_SQL + """
, lab AS (SELECT r.user_id % 50 AS seed, r.appid, CASE WHEN min(rating) >= 5 THEN 'positive' ELSE 'negative' END AS label FROM ratings r GROUP BY 1, 2)""" + PAIR_VALUE_SQL.format(
    keys="a.appid, b.appid AS seed, label", source="lab JOIN feat a ON a.appid = lab.appid JOIN feat b ON b.appid = lab.seed JOIN gs ga ON ga.appid = a.appid JOIN gs gb ON gb.appid = b.appid") + """
SELECT label, CASE WHEN label = 'positive' THEN k >= 0.1 ELSE k < 0.05 END AS passed, count(*) AS n FROM pv GROUP BY 1, 2""")
def _(t):
    labels = t.ratings.groupBy((F.col("user_id") % 50).alias("seed"), "appid").agg(F.when(F.min("rating") >= 5, "positive").otherwise("negative").alias("label"))
    rows = features(t)
    seeds = rows.join(labels.select(F.col("seed").alias("appid")).distinct(), "appid", "left_semi")
    return K.evaluate_labels(K.pairwise_kernel(rows, seeds, taxonomy(t)), labels)


TOP_SQL = """ SELECT user_id, appid, CAST(rank AS INTEGER) AS rank, round(x, 6) + 0e0 AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(x, 9) DESC, appid) AS rank FROM ux) WHERE rank <= 10"""


@check("kernel_rating_feature", PAIR_KERNEL_SQL + PAIR_VALUE_SQL.format(
    keys="a.appid, b.appid AS seed", source="feat b CROSS JOIN feat a JOIN gs ga ON ga.appid = a.appid JOIN gs gb ON gb.appid = b.appid") + """
, ux AS (SELECT user_id, pv.appid, sum(CASE WHEN pv.appid = seed THEN 0 ELSE exp(10 * k) END * (rating - 5)) / (sum(CASE WHEN pv.appid = seed THEN 0 ELSE exp(10 * k) END) + 1e-9) AS x
  FROM ratings r JOIN pv ON r.appid = pv.seed GROUP BY 1, 2)""" + TOP_SQL.format(name="x_kernel"))
def _(t):
    return K.rating_feature(features(t), t.ratings, taxonomy(t), k=10).select("user_id", "appid", "rank", r6("x_kernel"))


@check("graph_rating_feature", """
, p AS (SELECT a.appid, b.appid AS seed, CASE WHEN a.appid = b.appid THEN 0 ELSE greatest(0, list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) + 1e-9)) END AS w FROM vectors b CROSS JOIN vectors a),
ux AS (SELECT user_id, p.appid, sum(w * (rating - 5)) / (sum(w) + 1e-9) AS x FROM ratings r JOIN p ON r.appid = p.seed GROUP BY 1, 2)""" + TOP_SQL.format(name="x_graph"))
def _(t):
    return K.graph_feature(t.vectors, t.ratings, k=10).select("user_id", "appid", "rank", r6("x_graph"))


@check("softmin_blends", FEATURES_SQL + """
, s AS (SELECT appid, [dz, tz, topics[1] * 5] AS s FROM feat), e AS (SELECT appid, unnest(s) AS x, list_min(s) AS lo FROM s)
SELECT appid, round(sum(x * exp((lo - x) / 3.0)) / sum(exp((lo - x) / 3.0)), 6) + 0e0 AS blend FROM e GROUP BY 1""")
def _(t):
    signals = F.array("difficulty_z", "tone_z", F.col("topics")[0] * 5)
    return features(t).select("appid", V.softmin_blend(signals).alias("blend")).select("appid", r6("blend"))


PUZZLE_SQL = """SELECT appid, CASE WHEN list_has_any(tag_set, ['NATION_2']) THEN 'A' WHEN list_has_any(tag_set, ['NATION_4', 'NATION_5']) THEN 'B' WHEN list_has_any(tag_set, ['NATION_7']) AND list_has_any(tag_set, ['NATION_8', 'NATION_9']) THEN 'C' ELSE 'Generic/Other' END AS puzzle_class,
  CASE WHEN NOT list_has_any(tag_set, ['NATION_10', 'NATION_11', 'NATION_12']) THEN 0.0::DOUBLE ELSE greatest(CASE WHEN list_contains(tag_set, 'NATION_1') THEN CASE WHEN list_contains(tag_set, 'NATION_10') THEN 0.95 ELSE 0.6 END ELSE 0 END,
    CASE WHEN list_contains(tag_set, 'NATION_3') THEN CASE WHEN list_contains(tag_set, 'NATION_11') THEN 0.4 ELSE 0.25 END ELSE 0 END) END AS chance,
  CAST(CASE WHEN len(list_intersect(tag_set, ['NATION_1', 'NATION_3'])) >= 1 AND list_has_any(tag_set, ['NATION_10', 'NATION_11', 'NATION_12']) THEN 3 WHEN len(list_intersect(tag_set, ['NATION_1', 'NATION_3'])) >= 2 THEN 2
    ELSE len(list_intersect(tag_set, ['NATION_1', 'NATION_3'])) END AS INTEGER) AS tier FROM ts"""


def puzzle_rows(t):
    sets = K.soul_tags(t.votes, 0.5).groupBy("appid").agg(F.collect_set("tag").alias("tag_set"))
    innocent = ("NATION_10", "NATION_11", "NATION_12")
    classes = (("A", ("NATION_2",), ()), ("B", ("NATION_4", "NATION_5"), ()), ("C", ("NATION_7",), ("NATION_8", "NATION_9")))
    rules = {"NATION_1": (((("NATION_10",), 0.95),), 0.6), "NATION_3": (((("NATION_11",), 0.4),), 0.25)}
    return sets.select("appid", K.puzzle_class(classes=classes).alias("puzzle_class"), K.subversion_chance(innocent=innocent, rules=rules).alias("chance"),
                       K.subversion_tier(meta=("NATION_1", "NATION_3"), innocent=innocent).alias("tier"))


@check("puzzle_class_and_subversion", FEATURES_SQL + PUZZLE_SQL)
def _(t):
    return puzzle_rows(t)


@check("subversion_of_neighbours", FEATURES_SQL + ", pz AS (" + PUZZLE_SQL + """)
SELECT a.appid, CASE WHEN a.tier >= 3 THEN CASE WHEN b.tier >= 3 THEN 0.45 WHEN b.tier >= 2 THEN 0.25 ELSE -0.30 END WHEN a.tier >= 2 THEN CASE WHEN b.tier >= 2 THEN 0.25 ELSE -0.20 END
  WHEN a.tier = 0 AND b.tier >= 2 THEN -0.30 ELSE 0.0 END::DOUBLE AS bonus,
  round(CASE WHEN a.puzzle_class <> 'Generic/Other' AND b.puzzle_class <> 'Generic/Other' AND a.puzzle_class <> b.puzzle_class THEN -0.3 ELSE 0 END + 0.45 * sqrt(a.chance * b.chance), 6) AS adjustment
FROM pz a JOIN pz b ON b.appid = a.appid + 1""")
def _(t):
    rows = puzzle_rows(t)
    other = rows.select((F.col("appid") - 1).alias("appid"), F.col("puzzle_class").alias("class_b"), F.col("chance").alias("chance_b"), F.col("tier").alias("tier_b"))
    adjusted = K.pair_adjustment(F.col("puzzle_class"), F.col("class_b"), F.col("chance"), F.col("chance_b"))
    return rows.join(other, "appid").select("appid", K.tier_bonus(F.col("tier"), F.col("tier_b")).cast("double").alias("bonus"), adjusted.alias("adjustment")).select("appid", "bonus", r6("adjustment"))


@check("three_modality_match", FEATURES_SQL + """
, s AS (SELECT * FROM feat ORDER BY n DESC, appid LIMIT 1),
m AS (SELECT f.appid, (list_dot_product(f.vec, s.vec) / (sqrt(list_dot_product(f.vec, f.vec)) * sqrt(list_dot_product(s.vec, s.vec)) + 1e-9) + list_dot_product(f.verbs, s.verbs) / (sqrt(list_dot_product(f.verbs, f.verbs)) * sqrt(list_dot_product(s.verbs, s.verbs)) + 1e-9)
  + list_dot_product(f.topics, s.topics) / (sqrt(list_dot_product(f.topics, f.topics)) * sqrt(list_dot_product(s.topics, s.topics)) + 1e-9)) / 3 AS similarity FROM feat f, s WHERE f.appid <> s.appid)
SELECT appid, round(similarity, 6) AS similarity FROM m ORDER BY m.similarity DESC, appid LIMIT 10""")
def _(t):
    rows = features(t)
    seed = rows.orderBy(F.desc("n"), "appid").limit(1).select(F.struct("appid", "vec", "verbs", "topics").alias("s")).scalar()
    both = rows.withColumn("_s", seed).filter(F.col("appid") != F.col("_s.appid"))
    mean = sum((V.cosine(F.col(c), F.col(f"_s.{c}")) for c in ("vec", "verbs", "topics")), F.lit(0.0)) / 3
    return both.select("appid", mean.alias("similarity")).orderBy(F.desc("similarity"), "appid").limit(10).select("appid", r6("similarity"))


