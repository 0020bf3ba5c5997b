"""Z-scores, average ranks and normal scores, without an unpartitioned window or a one-task sort."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.normal import quantile
from curatrix.session import parallelism

EPSILON = 1e-9


def r6(column: str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, under the same name."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(column)


def _bounded(z: Column, clamp: tuple[float, float] | None) -> Column:
    return z if clamp is None else F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), z))


def moments(df: DataFrame, value: Column, *, ignore_zeros: bool = False, sample: bool = False) -> Column:
    """Mean and deviation of a column as a one-row scalar struct (``m``, ``sd``)."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    if ignore_zeros:
        nonzero = F.when(F.abs(value) > 1e-5, value)
        m, sd = F.coalesce(F.avg(nonzero), F.avg(value)), F.coalesce(deviation(nonzero), deviation(value))
    else:
        m, sd = F.avg(value), deviation(value)
    return df.agg(F.struct(m.alias("m"), sd.alias("sd")).alias("s")).scalar()


def to_z(df: DataFrame, columns: dict[str, str], *, ignore_zeros: bool = False,
         clamp: tuple[float, float] | None = None) -> DataFrame:
    """Population z-scores of several columns, all moments from one pass: ``{source: target}``."""
    stats = df.agg(F.struct(*[
        F.struct(*_moment_pair(F.col(c), ignore_zeros)).alias(f"s{i}") for i, c in enumerate(columns)]).alias("s")).scalar()
    out = df.withColumn("_stats", stats)
    made = {}
    for i, (source, target) in enumerate(columns.items()):
        m, sd = F.col(f"_stats.s{i}.m"), F.col(f"_stats.s{i}.sd")
        made[target] = _bounded((F.col(source) - m) / F.when(sd > EPSILON, sd).otherwise(F.lit(1.0)), clamp)
    return out.withColumns(made).drop("_stats")


def _moment_pair(value: Column, ignore_zeros: bool) -> list[Column]:
    if not ignore_zeros:
        return [F.avg(value).alias("m"), F.stddev_pop(value).alias("sd")]
    nonzero = F.when(F.abs(value) > 1e-5, value)
    return [F.coalesce(F.avg(nonzero), F.avg(value)).alias("m"),
            F.coalesce(F.stddev_pop(nonzero), F.stddev_pop(value)).alias("sd")]


def popularity_z(df: DataFrame) -> DataFrame:
    logged = df.withColumn("_log", F.log1p(F.col("positive") + F.col("negative")))
    return to_z(logged, {"_log": "pop_z"}).drop("_log")


def price_z(df: DataFrame, price: str = "price_numeric") -> DataFrame:
    """Sample z-score of the logged price among priced items, 0 for the rest."""
    logged = df.withColumn("_log", F.log1p(F.col(price)))
    s = moments(logged, F.col("_log"), sample=True)
    z = F.when(F.col("_s.sd") > 0, (F.col("_log") - F.col("_s.m")) / F.col("_s.sd"))
    return logged.withColumn("_s", s).withColumn("price_z", F.coalesce(z, F.lit(0.0))).drop("_log", "_s")


def date_z(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Future dates count as the reference day; unknown dates score 0."""
    clamped = df.withColumn("parsed_date", F.when(F.col("parsed_date").isNotNull(), F.least(
        F.col("parsed_date"), F.lit(as_of).cast("timestamp"))))
    seconds = clamped.withColumn("_t", F.col("parsed_date").cast("double"))
    return to_z(seconds, {"_t": "date_z"}).withColumn("date_z", F.coalesce("date_z", F.lit(0.0))).drop("_t")


def year_or_mean(df: DataFrame, date: str = "parsed_date") -> DataFrame:
    mean = df.agg(F.avg(F.year(date)).alias("x")).scalar()
    return df.withColumn("release_year", F.coalesce(F.year(date).cast("double"), mean))


def difficulty_z(df: DataFrame, predictions: DataFrame, tagged: Column, neutral: float = 5.0) -> DataFrame:
    """Attach predicted difficulty (neutral where unknown) and its z-score over tagged items."""
    joined = df.join(predictions, "appid", "left").withColumn(
        "difficulty_predicted", F.coalesce("difficulty_predicted", F.lit(neutral)))
    s = moments(joined.filter(tagged), F.col("difficulty_predicted"))
    z = (F.col("difficulty_predicted") - F.col("_s.m")) / F.when(F.col("_s.sd") > EPSILON, F.col("_s.sd")).otherwise(F.lit(1.0))
    return joined.withColumn("_s", s).withColumn("difficulty_z", F.coalesce(z, F.lit(0.0))).drop("_s")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), pieces: int | None = None,
                weight: str | None = None) -> DataFrame:
    """Average rank of every distinct value: columns ``by``, ``value``, ``rank_avg``, ``ties``, ``n``.

    Equal values collapse first, so a hot value is one row. The distinct values are then cut into
    ranges by approximate quantiles (a bounded sketch, ``pieces`` numbers per group), counted within
    each range in parallel, and shifted by the totals of the ranges below. ``by`` names groups such as features or
    discovery steps, each with its own ranges; for many small groups use ``group_ranks``. ``weight`` is a
    column with the number of rows a row stands for.
    """
    by = list(by)
    pieces = pieces or max(8, parallelism(df))
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_c"))
    cuts = [i / pieces for i in range(1, pieces)]
    sketch = F.array_distinct(F.percentile_approx(value, cuts, 1000).cast("array<double>"))
    if by:
        bounds = distinct.groupBy(*by).agg(sketch.alias("_b"))
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        placed = distinct.alias("d").join(bounds.alias("b"), same).select("d.*", F.size(F.filter("b._b", lambda e: e < F.col(f"d.{value}"))).alias("_piece"))
    else:
        edges = sorted(set(distinct.agg(sketch.alias("b")).first()["b"] or []))
        below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
        placed = distinct.withColumn("_piece", below)
    inside = W.partitionBy(*by, "_piece").orderBy(value)
    local = placed.withColumn("_upto", F.sum("_c").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    totals = placed.groupBy(*by, "_piece").agg(F.sum("_c").alias("_t"))
    across = W.partitionBy(*by).orderBy("_piece") if by else W.partitionBy(F.lit(0)).orderBy("_piece")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    shifts = totals.select(*by, "_piece", (F.sum("_t").over(across.rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_shift"),
                           F.sum("_t").over(whole).alias("n"))
    joined = local.join(F.broadcast(shifts), [*by, "_piece"])  # at most groups x pieces rows
    rank = F.col("_shift") + F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)
    return joined.select(*by, value, rank.alias("rank_avg"), F.col("_c").alias("ties"), "n")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.join(value_ranks(df, value, by), [*by, value])


def group_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Average ranks inside many groups of bounded size (one user's ratings, one seed's candidates)."""
    ties, up = W.partitionBy(*by, value), W.partitionBy(*by).orderBy(value)
    rank = F.rank().over(up) + (F.count("*").over(ties) - 1) / F.lit(2.0)
    return df.withColumns({"rank_avg": rank, "n": F.count("*").over(W.partitionBy(*by))})


def quantile_scores(df: DataFrame, value: str, by: Sequence[str] = (), target: str = "score") -> DataFrame:
    """Normal scores at (rank - 1/2) / n."""
    ranked = value_ranks(df, value, by).withColumn("_p", (F.col("rank_avg") - 0.5) / F.col("n"))
    return df.join(ranked.select(*by, value, quantile("_p").alias(target)), [*by, value])


def rank_normal(df: DataFrame, value: str, by: Sequence[str], target: str = "z", offset: float = 0.375) -> DataFrame:
    """Rank-based inverse normal transform per feature (Blom offset); a constant feature becomes 0."""
    ranked = value_ranks(df, value, by)
    size = ranked.groupBy(*by).agg(F.count("*").alias("_levels"))
    scored = (ranked.join(F.broadcast(size), list(by))
              .withColumn("_p", (F.col("rank_avg") - offset) / (F.col("n") - 2 * offset + 1))
              .withColumn(target, F.when(F.col("_levels") > 1, quantile("_p")).otherwise(F.lit(0.0))))
    return df.join(scored.select(*by, value, target), [*by, value])
