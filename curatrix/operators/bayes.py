"""Quality scores pulled to a prior, the discovery grid and the ratings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import normal
from curatrix.operators.aggregates import smoothed_rate
from curatrix.operators.joins import interpolate
from curatrix.operators.normalize import to_z, value_ranks

# Prior strength at discovery 0 and its base, and the grid of discovery settings.
STRENGTH, STRENGTH_BASE = 2000.0, 80.0
STEPS = tuple(round(-1.0 + 0.1 * i, 1) for i in range(21))
# Rating scale of personalized quality, playtime kernel width and prior weight.
RATING_SLOPE, RATING_INTERCEPT = 3.008809, 3.277190
KERNEL_WIDTH, KERNEL_PRIOR = 0.688395, 1.452654
PLAYTIME_STRENGTH = 1.159365


def strength_at(discovery: float) -> float:
    return STRENGTH * STRENGTH_BASE ** (-discovery)


def quality(stats: DataFrame, rate: Column, discovery: float = 0.0, target: str = "q", strength: float | None = None) -> DataFrame:
    """Probit of the smoothed positive rate."""
    with_rate = stats.withColumn("_a", rate)
    p = smoothed_rate(strength_at(discovery) if strength is None else strength, F.col("_a"))
    return with_rate.withColumn("_p", p).withColumn(target, normal.quantile("_p")).drop("_p", "_a")


def quality_grid(stats: DataFrame, rate: Column, steps: tuple[float, ...] = STEPS, strength: float = STRENGTH) -> DataFrame:
    """Quality at every discovery step as normal scores: (step, appid, q).

    Items with equal counts share every score, so the steps multiply distinct (positive, negative)
    pairs only, and the scores are joined back.
    """
    counts = stats.groupBy("positive", "negative").agg(F.count("*").alias("_n")).withColumn("_a", rate)
    powers = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(strength * STRENGTH_BASE ** (-v)).alias("s")) for i, v in enumerate(steps)])
    spread = counts.select("positive", "negative", "_n", "_a", F.inline(powers))
    shares = spread.withColumn("share", smoothed_rate(F.col("s"), F.col("_a"))).select("step", "positive", "negative", "_n", "share")
    ranked = value_ranks(shares, "share", ["step"], weight="_n").withColumn("_p", (F.col("rank_avg") - 0.5) / F.col("n"))
    scores = ranked.select("step", "share", normal.quantile("_p").alias("q"))
    by_counts = shares.join(scores, ["step", "share"]).select("step", "positive", "negative", "q")
    return stats.select("appid", "positive", "negative").join(by_counts, ["positive", "negative"]).select("step", "appid", "q")


def grid_step(slider: float, steps: int = 21) -> int:
    """Grid row of a slider in -1..1, clamped."""
    return max(0, min(steps - 1, round((slider + 1.0) / 2.0 * (steps - 1))))


def grid_step_column(slider: Column, steps: int = 21) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.bround((slider + 1.0) / 2.0 * (steps - 1)).cast("int")))


def playtime_estimates(stats: DataFrame, strength: float = PLAYTIME_STRENGTH) -> DataFrame:
    """Median playtimes pulled to the mean of logs; columns ``estimated_playtime`` and ``playtime_z``."""
    prior = stats.agg(F.coalesce(F.avg(F.when(F.col("review_count") > 0, F.log1p("median_playtime"))), F.lit(0.0)).alias("x")).scalar()
    filled = stats.withColumn("_mu", prior).withColumns({
        "median_playtime": F.coalesce("median_playtime", F.expm1("_mu")), "review_count": F.coalesce("review_count", F.lit(0))})
    shrunk = (F.col("review_count") * F.log1p("median_playtime") + F.lit(strength) * F.col("_mu")) / (F.col("review_count") + F.lit(strength))
    scored = to_z(filled.withColumn("_log", shrunk), {"_log": "playtime_z"})
    return scored.withColumn("estimated_playtime", F.expm1("_log")).drop("_log", "_mu")


def personalized_quality(df: DataFrame, q: str, p: str, target: str = "personalized_q") -> DataFrame:
    """Quality moved by how much more a user's chance of a positive vote is than the item's."""
    staged = df.withColumns({"_cdf": normal.cdf(q), "_pdf": normal.density(q)})
    shift = F.col(p) / (F.col("_cdf") + F.lit(1e-12)) - (F.lit(1.0) - F.col(p)) / (F.lit(1.0) - F.col("_cdf") + F.lit(1e-12))
    return staged.withColumn(target, F.col(q) + F.col("_pdf") * shift).drop("_cdf", "_pdf")


def rating_of(quality_column: Column, slope: float = RATING_SLOPE, intercept: float = RATING_INTERCEPT) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(quality_column * slope + intercept).cast("int")))


def personalize_owned(items: DataFrame, own: DataFrame, q: str = "q") -> DataFrame:
    """Replace the quality of a user's items by the personalized one (``own``: appid, p_plus)."""
    joined = items.join(own.select("appid", "p_plus"), "appid", "left")
    scored = personalized_quality(joined, q, "p_plus", "_pq")
    return scored.withColumn("is_personalized", F.col("p_plus").isNotNull()).withColumn(
        q, F.when(F.col("p_plus").isNotNull(), F.col("_pq")).otherwise(F.col(q))).drop("_pq", "p_plus")


def match_percent(scored: DataFrame, score: str, curve: DataFrame, quality_weight: float, neutral: float = 5.0) -> DataFrame:
    """Score as the chance of a positive vote of the item that quality alone would score the same (``curve``: cx grid, cy natural)."""
    weight = abs(quality_weight) if abs(quality_weight) > 1e-3 else 1.0
    equivalent = scored.withColumn("_x", (F.col(score) - F.lit(neutral)) / F.lit(weight))
    placed = interpolate(equivalent, "_x", curve, "_y")
    return placed.withColumn("match_percent", normal.cdf("_y") * 100.0).drop("_x", "_y")


def implied_strength(share: Column, rate: Column) -> Column:
    """Prior strength that turns the counts into a given smoothed share."""
    return F.try_divide(F.col("positive") - share * (F.col("positive") + F.col("negative")), share - rate)
