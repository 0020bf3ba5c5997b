"""Aggregations and statistics over items, reviews, tags and vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import normal
from curatrix.operators import orderstats
from curatrix.operators.normalize import value_ranks
from curatrix.operators.orderstats import group_percentiles
from curatrix.session import checkpointed

# ----------------------------------------------------------------------------- reviews


def review_stats(reviews: DataFrame) -> DataFrame:
    """Votes per item, and median and number of playtimes among positive reviews that were played.

    Reviews collapse to one row for each item and playtime; the medians are exact and need no item's values in one place.
    """
    played = F.when(F.col("voted_up") & (F.col("playtime") > 0), F.col("playtime"))
    levels = reviews.groupBy("appid", played.alias("_played")).agg(F.count_if("voted_up").alias("positive"), F.count_if(~F.col("voted_up")).alias("negative"), F.count("*").alias("count"))
    counts = levels.groupBy("appid").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"),
                                         F.coalesce(F.sum(F.when(F.col("_played").isNotNull(), F.col("count"))), F.lit(0)).alias("review_count"))
    medians = group_percentiles(levels, ["appid"], "_played", {"median_playtime": 0.5})
    return counts.join(medians.withColumnRenamed("appid", "_id"), F.col("appid").eqNullSafe(F.col("_id")), "left").select(
        "appid", "positive", "negative", "median_playtime", "review_count")


def bundle_text(reviews: DataFrame, first: int, separator: str = " ") -> DataFrame:
    """The first few review texts of each item in one text."""
    from curatrix.operators.toplists import top_k_by_group
    rows = top_k_by_group(reviews, ["appid"], [F.asc("ts"), F.asc("review_id")], first)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy("appid").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("bundle"))


def assembled_text(rows: DataFrame, key: str, order: Sequence[str], text: str = "text", separator: str = " | ", piece: int = 1 << 16) -> DataFrame:
    """All texts of a key in order, joined, as rows (``key``, ``part``, ``text``) of ``piece`` characters (the last may be shorter).

    Rows are range-partitioned by key and order, so a hot key spreads over partitions. Lengths are summed within a partition and key, then across
    partitions (one number for each), which gives every text its place in the joined one; a text that crosses a boundary is cut there. No task holds
    more of a key than a partition or a piece. Null texts are left out, as are keys without texts; equal orders go by the text.
    """
    kept = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text).alias("_text"))
    orders = [f"_o{i}" for i in range(len(order))] + ["_text"]
    placed = checkpointed(kept.repartitionByRange("_key", *orders).withColumn("_part", F.spark_partition_id()))
    step = F.length("_text") + F.lit(len(separator))
    inside = W.partitionBy("_key", "_part").orderBy(*orders)
    local = placed.withColumn("_end", F.sum(step).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    totals = placed.groupBy("_key", "_part").agg(F.sum(step).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most one row a partition
    shifts = totals.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), before.alias("_before"))
    joined = local.join(shifts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    # every text follows a separator, but the first: places count from the first text's first character
    start = F.col("_before") + F.col("_end") - step - F.lit(len(separator))
    pieces = joined.select("_key", F.concat(F.lit(separator), "_text").alias("_text"), start.alias("_at"))
    pieces = pieces.select("_key", F.expr(f"IF(_at < 0, substring(_text, {len(separator) + 1}), _text)").alias("_text"), F.greatest("_at", F.lit(0)).alias("_at")).filter((F.length("_text") > 0) | (F.col("_at") == 0))
    last = F.greatest(F.col("_at"), F.col("_at") + F.length("_text") - 1)
    cut = pieces.withColumn("part", F.explode(F.sequence(F.expr(f"_at div {piece}"), F.floor(last / piece))))
    low = F.greatest(F.col("part") * piece - F.col("_at"), F.lit(0))
    high = F.least((F.col("part") + 1) * piece - F.col("_at"), F.length("_text"))
    bits = cut.select("_key", "part", F.struct((F.col("_at") + low).alias("at"), F.length("_text").alias("n"), F.substring("_text", (low + 1).cast("int"), (high - low).cast("int")).alias("text")).alias("b"))
    whole = bits.groupBy("_key", "part").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return whole.select(F.col("_key").alias(key), F.col("part").cast("long").alias("part"), F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))


def positive_rate(stats: DataFrame, min_reviews: int = 100, fallback: float = 0.86) -> DataFrame:
    """Mean item rate over well reviewed items, else the pooled rate, else a constant: one row."""
    total = F.col("positive") + F.col("negative")
    reliable = F.avg(F.when(total >= min_reviews, F.col("positive") / total))
    pooled = F.try_divide(F.sum("positive"), F.sum(total))
    return stats.agg(F.coalesce(reliable, pooled, F.lit(fallback)).alias("rate"))


def keys_with_rows(reviews: DataFrame, at_least: int) -> DataFrame:
    valid = reviews.filter((F.col("playtime") > 0) & F.col("voted_up").isNotNull())
    return valid.groupBy("appid").agg(F.count("*").alias("count")).filter(F.col("count") >= at_least)


def smoothed_rate(strength: Column | float, rate: Column, clip: float = 1e-6) -> Column:
    """Positive share pulled to the prior rate by ``strength`` pseudo reviews."""
    s = F.lit(strength) if isinstance(strength, (int, float)) else strength
    share = (F.col("positive") + s * rate) / (F.col("positive") + F.col("negative") + s)
    return F.greatest(F.lit(clip), F.least(F.lit(1 - clip), share))


def rating_anchors(stats: DataFrame, strength: float, rate: Column) -> DataFrame:
    """Slope and intercept that map personalized quality to 0-10, with the names of the extreme items."""
    q = stats.withColumn("_p", smoothed_rate(strength, rate)).withColumn("q", normal.quantile("_p"))
    ends = q.agg(F.max("q").alias("hi"), F.min("q").alias("lo"),
                 F.max_by("appid", F.struct("q", -F.col("appid"))).alias("best_appid"),
                 F.min_by("appid", F.struct("q", "appid")).alias("worst_appid"))
    full = ends.withColumns({"_top": F.col("hi") + normal.density("hi") / normal.cdf("hi"),
                             "_bottom": F.col("lo") - normal.density("lo") / (F.lit(1.0) - normal.cdf("lo"))})
    slope = F.lit(10.0) / (F.col("_top") - F.col("_bottom"))
    return full.select("best_appid", "worst_appid", slope.alias("slope"), (-slope * F.col("_bottom")).alias("intercept"))


# ----------------------------------------------------------------------------- vocabularies and tags


def vocabulary(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Distinct members of an array column."""
    return df.select(F.explode(column).alias("name")).filter("name <> ''").distinct().select(F.lit(kind).alias("kind"), "name").orderBy("name")


def tag_shares(tags: DataFrame, within: DataFrame) -> DataFrame:
    """Items per tag and their share among tagged items, for all items and for a sub-population."""
    marked = tags.join(within.select("appid").distinct().withColumn("_in", F.lit(True)), "appid", "left")
    base = marked.agg(F.struct(F.count_distinct("appid").alias("n"), F.count_distinct(F.when(F.col("_in"), F.col("appid"))).alias("m")).alias("x")).scalar()
    counts = marked.groupBy("tag").agg(F.count("*").alias("items"), F.count("_in").alias("items_within"))
    shares = counts.withColumn("_b", base)
    return shares.select("tag", "items", "items_within", (F.col("items") / F.col("_b.n")).alias("share"),
                         F.try_divide("items_within", F.col("_b.m")).alias("share_within"))


def tag_prior(votes: DataFrame) -> DataFrame:
    """Share of all votes per tag."""
    total = votes.agg(F.sum("votes").alias("x")).scalar()
    return votes.groupBy("tag").agg(F.sum("votes").alias("v")).withColumn("_t", total).select("tag", (F.col("v") / F.col("_t")).alias("share"))


def mean_profile(votes: DataFrame, more_than: float = 1000) -> DataFrame:
    """Mean tag profile of items with more votes than a bound; of all voted items where none has."""
    totals = votes.groupBy("appid").agg(F.sum("votes").alias("total"))
    has_any = totals.agg(F.coalesce(F.max("total") > more_than, F.lit(False)).alias("x")).scalar()
    kept = totals.filter(F.when(has_any, F.col("total") > more_than).otherwise(F.col("total") > 0))
    n = kept.agg(F.count("*").alias("x")).scalar()
    shares = votes.join(kept, "appid").groupBy("tag").agg(F.sum(F.col("votes") / F.col("total")).alias("s"))
    return shares.withColumn("_n", n).select("tag", (F.col("s") / F.col("_n")).alias("share"))


def family_overlap(tags: DataFrame, items: DataFrame, family: Sequence[str], other: Sequence[str], k: int = 5) -> DataFrame:
    """Items that carry a tag of one family: how many, how many of them carry one of the other, and the most reviewed."""
    from curatrix.operators.toplists import top_k_by_group
    flags = tags.groupBy("appid").agg(F.bool_or(F.col("tag").isin(*family)).alias("in_family"), F.bool_or(F.col("tag").isin(*other)).alias("in_other"))
    pool = flags.filter("in_family")
    counts = pool.agg(F.count("*").alias("n_family"), F.count_if("in_other").alias("n_both")).withColumn("share", F.try_divide("n_both", "n_family"))
    both = pool.filter("in_other").join(items.select("appid", "n"), "appid").withColumn("g", F.lit(1))
    top = top_k_by_group(both, ["g"], [F.desc("n"), F.asc("appid")], k)
    pooled = counts.select(F.struct("n_family", "n_both", "share").alias("x")).scalar()
    return top.withColumn("_c", pooled).select("rank", "appid", "n", "_c.n_family", "_c.n_both", "_c.share")


# ----------------------------------------------------------------------------- distributions


def summary(df: DataFrame, value: str, percentiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Moments, extremes and exact percentiles of a column."""
    x = F.col(value)
    exact = orderstats.percentiles(df, x, percentiles)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
                  F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
                  *[F.lit(v).cast("double").alias(f"p{round(p * 100):02d}") for p, v in zip(percentiles, exact)])


def calibration(df: DataFrame, x: str, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """Mean prediction and actual rate per quantile bin of ``x`` (bin edges are exact percentiles)."""
    edges = sorted({e for e in orderstats.percentiles(df, x, [i / bins for i in range(1, bins)]) if e is not None})
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(x))) if edges else F.lit(0)
    return df.withColumn("bin", place).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(predicted).alias("mean_predicted"), F.avg(F.col(actual).cast("int")).alias("actual_rate"))


def classification_scores(df: DataFrame, predicted: str, actual: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of a probability at a cut."""
    yes, truth = F.col(predicted) >= cut, F.col(actual)
    counts = df.agg(F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"), F.count_if(~yes & truth).alias("fn"), F.count("*").alias("n"))
    return counts.select(((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"),
                         F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
                         F.try_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def chi_cdf(x: Column, degrees: int) -> Column:
    """Distribution function of a Chi variable with an even number of degrees of freedom (a finite sum)."""
    if degrees % 2:
        raise ValueError("only even degrees of freedom have the finite form")
    half = x * x / 2
    terms = F.lit(1.0)
    for i in range(degrees // 2 - 1, 0, -1):
        terms = F.lit(1.0) + half / F.lit(float(i)) * terms
    return F.lit(1.0) - F.exp(-half) * terms


def kolmogorov_smirnov(df: DataFrame, value: str, cdf: Column) -> DataFrame:
    """Largest distance between the empirical and a given distribution function (``cdf`` over ``value``)."""
    steps = value_ranks(df, value)
    upto = F.col("rank_avg") + (F.col("ties") - 1) / F.lit(2.0)
    above, below = F.abs(upto / F.col("n") - cdf), F.abs((upto - F.col("ties")) / F.col("n") - cdf)
    return steps.agg(F.max(F.greatest(above, below)).alias("ks"), F.max("n").alias("n"))


def density(df: DataFrame, value: str, by: Sequence[str], points: Sequence[float], bandwidth: Column | None = None) -> DataFrame:
    """Gaussian kernel density per group on fixed points. Equal values are counted once; ``bandwidth`` may use ``n``."""
    by = list(by)
    return _smoothed_density(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")), value, by, points, bandwidth)


def _smoothed_density(counted: DataFrame, value: str, by: list[str], points: Sequence[float], bandwidth: Column | None = None) -> DataFrame:
    """Density from counts ``_c`` per group and value."""
    h = bandwidth if bandwidth is not None else F.greatest(F.lit(0.5), F.pow(F.sqrt("n"), F.lit(-0.2)) * 1.06)
    sized = counted.groupBy(*by).agg(F.sum("_c").alias("n")).withColumn("h", h)
    joined = counted.join(sized, by) if by else counted.withColumn("_s", sized.select(F.struct("n", "h").alias("x")).scalar()).select(value, "_c", "_s.*")
    spread = joined.withColumn("x", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    bump = F.col("_c") * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col(value)) / F.col("h"), F.lit(2.0)))
    return spread.groupBy(*by, "x").agg((F.sum(bump) / (F.first("n") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def complement_density(df: DataFrame, tagged: DataFrame, value: str, by: str, points: Sequence[float]) -> DataFrame:
    """Density on fixed points of the rows that lack a group: all of ``df`` less the group's rows in ``tagged`` (rows of ``df``, at most one a group).

    Counts per value are subtracted, so no row is matched against the groups it is not in.
    """
    every = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_all"))
    values = every.agg(F.collect_list(F.struct(F.col(value).alias("v"), "_all")).alias("x")).scalar()
    groups = tagged.select(by).distinct().withColumn("_v", values).select(by, F.inline("_v"))
    own = tagged.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("_own"))
    rest = groups.join(own, [by, "v"], "left").withColumn("_c", F.col("_all") - F.coalesce("_own", F.lit(0))).filter("_c > 0").select(by, F.col("v").alias(value), "_c")
    return _smoothed_density(rest, value, [by], points)


def theoretical_moments(df: DataFrame, value: str, mean: float, variance: float) -> DataFrame:
    """Observed mean and variance of a column beside those a law predicts: one row."""
    return df.agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.lit(mean).alias("law_mean"), F.lit(variance).alias("law_variance"))


def chi_moments(degrees: int) -> tuple[float, float]:
    """Mean and variance of a Chi variable."""
    mean = math.sqrt(2) * math.exp(math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2))
    return mean, degrees - mean * mean


def trend(df: DataFrame, x: Column, y: Column) -> DataFrame:
    pairs = df.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


# ----------------------------------------------------------------------------- tag effects on ratings


def _student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t as a regularized incomplete beta, by Lentz's continued fraction."""
    x, a, b = df / (df + t * t), df / 2.0, np.full_like(df, 0.5)
    swap = x > (a + 1.0) / (a + b + 2.0)
    x2, a2, b2 = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a2 + b2) - lgamma(a2) - lgamma(b2) + a2 * np.log(x2) + b2 * np.log1p(-x2)) / a2
        tiny = 1e-300
        c, d = np.ones_like(x2), 1.0 / np.where(np.abs(1 - (a2 + b2) * x2 / (a2 + 1)) < tiny, tiny, 1 - (a2 + b2) * x2 / (a2 + 1))
        f = d.copy()
        for m in range(1, 200):
            for numerator in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)),
                              -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
                d = 1.0 / np.where(np.abs(1 + numerator * d) < tiny, tiny, 1 + numerator * d)
                c = np.where(np.abs(1 + numerator / c) < tiny, tiny, 1 + numerator / c)
                f = f * c * d
        tail = front * f
    return np.clip(np.where(swap, 1 - tail, tail), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if known.any():
        out[known] = _student_tail(np.abs(t[known].to_numpy(float)), df[known].to_numpy(float))
    return out


def tag_effects(ratings: DataFrame, tags: DataFrame, min_size: int = 5) -> DataFrame:
    """Welch's t per user and tag: ratings with the tag against those without (totals minus the tag's sums)."""
    r = F.col("rating").cast("double")
    sums = [F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q")]
    total = ratings.groupBy("user_id").agg(*sums).select("user_id", F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("q").alias("tq"))
    # an item's tags travel as one list of their places in the vocabulary, and a user's rows meet before they are spread over the tags
    lists = checkpointed(tags.groupBy("appid").agg(F.collect_list(F.struct("tag")).alias("_tags")))
    vocabulary = lists.select(F.inline("_tags")).distinct().agg(F.array_sort(F.collect_list("tag")).alias("v")).scalar()
    coded = lists.withColumn("_v", vocabulary).select("appid", F.sort_array(F.transform("_tags", lambda e: F.array_position("_v", e["tag"]).cast("int"))).alias("_tags"))
    mine = ratings.select("user_id", "appid", "rating").join(coded, "appid").select("user_id", "rating", "_tags").repartition("user_id")
    with_tag = mine.select("user_id", "rating", F.explode("_tags").alias("_tag")).groupBy("user_id", "_tag").agg(*sums)
    with_tag = with_tag.withColumn("_v", vocabulary).withColumn("tag", F.get("_v", F.col("_tag") - 1)).drop("_v", "_tag")
    both = with_tag.join(total, "user_id").withColumns({"m": F.col("tn") - F.col("n")}).filter((F.col("n") >= min_size) & (F.col("m") >= min_size))
    # try_divide: a pushed-down condition may meet rows that the size filter has yet to drop
    mean_with, mean_without = F.try_divide("s", "n"), F.try_divide(F.col("ts") - F.col("s"), "m")
    var_with = F.try_divide(F.col("q") - F.col("s") * mean_with, F.col("n") - 1)
    var_without = F.try_divide(F.col("tq") - F.col("q") - (F.col("ts") - F.col("s")) * mean_without, F.col("m") - 1)
    a, b = F.try_divide(F.greatest(var_with, F.lit(0.0)), "n"), F.try_divide(F.greatest(var_without, F.lit(0.0)), "m")
    parts = both.select("user_id", "tag", F.col("n").alias("n_with"), F.col("m").alias("n_without"), mean_with.alias("mean_with"),
                        mean_without.alias("mean_without"), a.alias("a"), b.alias("b"))
    diff = F.col("mean_with") - F.col("mean_without")
    spread = F.col("a") + F.col("b")
    return parts.select("user_id", "tag", "n_with", "n_without", "mean_with", "mean_without", diff.alias("diff"),
                        F.when(spread > 1e-12, F.try_divide(diff, F.sqrt(spread))).alias("t"),
                        F.when(spread > 1e-12, F.try_divide(spread * spread, F.try_divide(F.col("a") * F.col("a"), F.col("n_with") - 1)
                                                            + F.try_divide(F.col("b") * F.col("b"), F.col("n_without") - 1))).alias("df"))


def significant_effects(effects: DataFrame, level: float = 0.05, positive_only: bool = True) -> DataFrame:
    tested = effects.withColumn("p", two_sided_p(F.col("t"), F.col("df"))).filter(F.col("p") < level)
    return tested.filter("diff > 0") if positive_only else tested


# ----------------------------------------------------------------------------- vectors


def dimension_moments(df: DataFrame, vector: str = "vec") -> DataFrame:
    """Mean and population deviation of every dimension."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def variance_multiplier(base: DataFrame, other: DataFrame, vector: str = "vec") -> DataFrame:
    """Factor that gives the other modality the base's mean variance per dimension."""
    def mean_variance(df: DataFrame) -> Column:
        return dimension_moments(df, vector).agg(F.avg(F.col("std") * F.col("std")).alias("x")).scalar()

    spark = base.sparkSession
    return spark.range(1).select(F.sqrt(mean_variance(base) / mean_variance(other)).alias("multiplier"))


def natural_range(pairs: DataFrame, similarity: Column) -> DataFrame:
    """Mean and deviation of a similarity over sampled pairs."""
    return pairs.agg(F.avg(similarity).alias("mean"), F.stddev_pop(similarity).alias("std"), F.count("*").alias("n"))


def random_pairs(df: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Pairs of distinct rows whose keys meet: ``vec`` and ``vec2``. Keys spread rows evenly, about one partner each."""
    left = df.select(F.col("appid"), "vec", left_key.alias("_k"))
    right = df.select(F.col("appid").alias("appid2"), F.col("vec").alias("vec2"), right_key.alias("_k"))
    return left.join(right, "_k").filter(F.col("appid") != F.col("appid2")).drop("_k")


def similarity_penalty(norms: DataFrame, norm: str = "norm", cut: float = 5.0, level: float = 0.95, least: int = 10) -> DataFrame:
    """Penalty added to vector lengths: a high percentile of the usable norms; 1 when too few are usable."""
    usable = norms.filter((F.col(norm) > 1e-6) & (F.col(norm) <= cut))
    high = orderstats.percentiles(usable, norm, [level])[0]
    return usable.agg(F.when(F.count("*") > least, F.lit(high).cast("double")).otherwise(F.lit(1.0)).alias("penalty"),
                      F.avg(norm).alias("mean_norm"), F.var_samp(norm).alias("var_norm"), F.count("*").alias("n"))
