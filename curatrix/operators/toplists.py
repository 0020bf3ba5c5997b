"""Search, lists, top-k per group, playlists and details."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import fold_name


def top_k_by_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each input partition passes on k rows of a group at most before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def ends(df: DataFrame, value: str, k: int = 50, key: str = "appid") -> DataFrame:
    """The ``k`` highest and ``k`` lowest rows (ids break ties), as two top-k passes without a full sort."""
    top = df.orderBy(F.desc(value), key).limit(k).select(F.lit("top").alias("side"), key, "name", value)
    bottom = df.orderBy(F.asc(value), key).limit(k).select(F.lit("bottom").alias("side"), key, "name", value)
    return top.unionByName(bottom)


def list_items() -> Column:
    """What every public list leaves out."""
    return ~F.col("is_delisted") & ~F.col("is_hollow") & ~F.col("is_utility")


def length_list(df: DataFrame, k: int = 50) -> DataFrame:
    return ends(df.filter(list_items() & (F.col("estimated_playtime") > 0)), "estimated_playtime", k)


def popularity_list(df: DataFrame, k: int = 50) -> DataFrame:
    counted = df.withColumn("total_reviews", F.col("positive") + F.col("negative"))
    return ends(counted.filter(list_items() & (F.col("total_reviews") >= 1)), "total_reviews", k)


def age_list(df: DataFrame, as_of: dt.datetime, k: int = 50) -> DataFrame:
    return ends(df.filter(list_items() & (F.col("parsed_date") <= F.lit(as_of))), "parsed_date", k)


def difficulty_list(df: DataFrame, k: int = 50) -> DataFrame:
    return ends(df.filter(list_items()), "difficulty_predicted", k)


def quality_list(df: DataFrame, grid: DataFrame, step: int, k: int = 50) -> DataFrame:
    scored = df.join(grid.filter(F.col("step") == step).select("appid", F.col("q").alias("quality_score")), "appid")
    return ends(scored.filter(list_items()), "quality_score", k)


def label_impacts(coefficients: DataFrame, topic_labels: DataFrame) -> DataFrame:
    """Feature coefficients with readable names: tags as they are, ``topic_<n>`` by its label."""
    named = coefficients.withColumn("topic", F.regexp_extract("feature", "^topic_(\\d+)$", 1).try_cast("int"))
    joined = named.join(F.broadcast(topic_labels.select("topic", "label")), "topic", "left")
    topic_name = F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), F.coalesce("label", F.lit("Unknown Topic")))
    return joined.select(F.when(F.col("topic").isNull(), F.col("feature")).otherwise(topic_name).alias("tag"), F.col("coefficient").alias("impact"),
                         F.when(F.col("topic").isNull(), "tag").otherwise("topic").alias("type")).orderBy(F.desc("impact"), "tag")


def search_names(df: DataFrame, query: str, limit: int = 50, name: str = "name", popularity: str = "pop_z") -> DataFrame:
    """Names containing the query: exact first, then prefixes, then popular ones; shown alphabetically."""
    if len(query) < 2:
        return df.limit(0)
    folded = df.select(fold_name(F.lit(query)).alias("q"), "*").withColumn("_n", fold_name(F.col(name)))
    hits = folded.filter(F.col("_n").contains(F.col("q")))
    ranked = hits.orderBy(F.desc(F.col("_n") == F.col("q")), F.desc(F.col("_n").startswith(F.col("q"))), F.desc(popularity), "appid").limit(limit)
    return ranked.drop("q", "_n").orderBy(F.lower(name), "appid")


def names(df: DataFrame, limit: int = 1000) -> DataFrame:
    return df.select(F.coalesce("name", F.lit("Unknown")).alias("name"), "appid").orderBy("name", "appid").limit(limit)


def details(df: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Full rows for wanted names with total reviews and hours."""
    rows = df.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.withColumns({"raw_pop": (F.col("positive") + F.col("negative")).cast("long"), "raw_length": F.col("mid_playtime") / 60})


def random_items(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A repeatable random choice; a smaller ``n`` with the same seed is a subset of a larger one."""
    return df.orderBy(F.xxhash64(F.col("appid"), F.lit(seed)), "appid").limit(n)


def status_order(status: str = "status") -> Column:
    order = ("rated", "played", "backlog", "unplayed", "wishlist", "ignored")
    out = F
    for i, s in enumerate(order):
        out = out.when(F.col(status) == s, i)
    return out.otherwise(len(order))


def playlists(scored: DataFrame, lists: dict[str, Column], k: int = 30, by: str = "user_id", score: str = "projected_rating") -> DataFrame:
    """Named top-k lists per user in one pass: a row goes to every list whose condition it meets."""
    member = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in lists.items()]), lambda x: x.isNotNull())
    rows = scored.withColumn("list", F.explode(member))
    return top_k_by_group(rows, [by, "list"], [F.desc(score), F.asc("appid")], k)


def neighbours_then_best(pairs: DataFrame, near: int = 100, best: int = 10) -> DataFrame:
    """Per user and favourite: the ``near`` most similar items, of which the ``best`` by predicted rating."""
    by = ["user_id", "seed"]
    closest = top_k_by_group(pairs, by, [F.desc("similarity"), F.asc("appid")], near, "near_rank")
    return top_k_by_group(closest, by, [F.desc("predicted_rating"), F.asc("appid")], best)


def tag_playlists(tag_effects: DataFrame, item_tags: DataFrame, scored: DataFrame, tags: int = 15, k: int = 5) -> DataFrame:
    """For each user's strongest tags, the best scored items that carry the tag."""
    strongest = top_k_by_group(tag_effects, ["user_id"], [F.desc("diff"), F.asc("tag")], tags, "tag_rank")
    rows = strongest.select("user_id", "tag", "diff", "tag_rank").join(item_tags.select("appid", "tag"), "tag").join(
        scored.select("user_id", "appid", "projected_rating"), ["user_id", "appid"])
    return top_k_by_group(rows, ["user_id", "tag"], [F.desc("projected_rating"), F.asc("appid")], k)


def smooth_curve(curve: DataFrame, x: str, y: str, sigma: float) -> DataFrame:
    """Gaussian smoothing of a short metric curve over its index, and its peak. Points meet their neighbours within
    four deviations by index, so the work grows with the curve, not its square."""
    reach = int(4 * sigma)
    spread = curve.select(F.explode(F.sequence(F.col(x) - reach, F.col(x) + reach)).alias("_at"), F.col(x).alias("_from"), F.col(y).alias("_y"))
    weight = F.exp(F.lit(-0.5) * F.pow((F.col("_at") - F.col("_from")) / F.lit(float(sigma)), F.lit(2.0)))
    smooth = spread.groupBy("_at").agg((F.sum(F.col("_y") * weight) / F.sum(weight)).alias("smooth"))
    out = curve.join(smooth, F.col(x) == F.col("_at")).drop("_at")
    top = out.agg(F.max_by(x, F.struct("smooth", -F.col(x))).alias("p")).scalar()
    return out.withColumn("peak", F.col(x) == top)


def rank_shifts(df: DataFrame, before: dict[int, Column], after: dict[int, Column], top: int, window: int) -> DataFrame:
    """How far a weight step moves a ranking, per scenario: squared shift of the old top, clamped shift of the old or new top.

    Only rows near the top matter: ranks are counted against the scores at the top's edge, never by sorting the whole table.
    """
    out = None
    for scenario in before:
        scored = df.select("appid", before[scenario].alias("s0"), after[scenario].alias("s1"))
        old = scored.orderBy(F.desc("s0"), "appid").limit(max(top, window))
        new = scored.orderBy(F.desc("s1"), "appid").limit(window)
        watched = old.union(new).distinct()  # at most twice the window
        probes = watched.agg(F.collect_list(F.struct("appid", "s0", "s1")).alias("x")).scalar()

        def ahead(score: str, row: Column) -> Column:
            return (F.col(score) > row[score]) | ((F.col(score) == row[score]) & (F.col("appid") < row["appid"]))

        hits = scored.withColumn("_w", probes).select("*", F.explode("_w").alias("w"))
        ranks = hits.groupBy(F.col("w.appid").alias("appid")).agg(
            (F.count_if(ahead("s0", F.col("w"))) + 1).alias("r0"), (F.count_if(ahead("s1", F.col("w"))) + 1).alias("r1"))
        r0, r1, edge = F.col("r0"), F.col("r1"), window + 1
        part = ranks.agg(F.avg(F.when(r0 <= top, F.pow((r1 - r0).cast("double"), F.lit(2.0)))).alias("squared_shift"),
                         F.avg(F.when((r0 <= window) | (r1 <= window), F.abs(F.least(r1, F.lit(edge)) - F.least(r0, F.lit(edge))))).alias("clamped_shift"))
        part = part.select(F.lit(scenario).alias("scenario"), "squared_shift", "clamped_shift")
        out = part if out is None else out.unionByName(part)
    return out


def target_ranks(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank of a named target among its seed's candidates: the number of better rows plus one, without sorting them."""
    goal = scored.join(pairs, (scored["seed"] == pairs["seed"]) & (scored["appid"] == pairs["target"])).select(
        pairs["seed"].alias("seed"), pairs["target"].alias("target"), scored["score"].alias("goal"))
    better = (F.col("score") > F.col("goal")) | ((F.col("score") == F.col("goal")) & (F.col("appid") < F.col("target")))
    return scored.join(goal, "seed").groupBy("seed", "target").agg((F.count_if(better) + 1).cast("int").alias("rank"))
