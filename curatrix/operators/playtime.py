"""Chance of a positive vote at a playtime: a kernel over an item's reviews in log playtime.

Reviews of an item collapse to one entry per distinct playtime first. Those entries are cut in chunks of
bounded size, and every chunk of asked playtimes meets every chunk of known ones as one block of numpy
work keyed by (item, chunk); no pair is ever a row, and a hot item spreads over many keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import normal
from curatrix.functions.beta import incomplete_beta
from curatrix.operators.aggregates import smoothed_rate
from curatrix.operators.bayes import KERNEL_PRIOR, KERNEL_WIDTH, personalized_quality, rating_of
from curatrix.operators.orderstats import group_percentiles
from curatrix.session import checkpointed, parallelism

CHUNK, POINT_CELLS, GRID_CELLS = 2048, 1 << 19, 1 << 17


def vote_histogram(reviews: DataFrame) -> DataFrame:
    """Votes per item and playtime."""
    played = reviews.filter((F.col("playtime") > 0) & F.col("voted_up").isNotNull())
    return played.groupBy("appid", F.col("playtime").alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.count_if("voted_up").cast("double").alias("up"))


def _field(entries: str, name: str) -> Column:
    return F.transform(entries, lambda r: r[name]).alias(name)


def _chunks(points: DataFrame, sizes: DataFrame, parts: str, columns: Sequence[str]) -> DataFrame:
    """Rows (appid, the columns of ``sizes``, chunk, arrays): at most about ``CHUNK`` distinct playtimes per row. ``parts`` names the column of ``sizes`` with an item's chunks."""
    keys = [*sizes.columns, "chunk"]
    placed = points.join(sizes, "appid").withColumn("chunk", F.pmod(F.xxhash64("x"), F.col(parts)).cast("int"))
    grouped = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("e"))
    return grouped.select(*keys, *[_field("e", c) for c in columns])


def _parts(count: Column) -> Column:
    return F.ceil(count / CHUNK).cast("int")


def weighted_votes(batch: pa.RecordBatch, gammas: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Summed weights of the asked playtimes of blocks (appid, x, kx, kn, kup), given away whenever ``POINT_CELLS`` sums have come together."""

    def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy()
        return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]

    def packed(flat: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(gammas), dtype=np.int32), flat.ravel())

    if not batch.num_rows:
        return
    (x, at), (kx, kat), (kn, _), (kup, _) = (lists(batch.column(i)) for i in range(1, 5))
    ids, logs, klogs, votes = batch.column(0).to_numpy(zero_copy_only=False), np.log(x + 1e-9), np.log(kx + 1e-9), np.column_stack([kn, kup])
    points, start = max(1, POINT_CELLS // len(gammas)), 0
    while start < batch.num_rows:
        end = int(max(start + 1, np.searchsorted(at, at[start] + points, side="right") - 1))
        totals, positives = np.empty((2, at[end] - at[start], len(gammas)))
        for i in range(start, end):
            gap = logs[at[i]:at[i + 1], None] - klogs[None, kat[i]:kat[i + 1]]
            half, out = -0.5 * gap * gap, slice(at[i] - at[start], at[i + 1] - at[start])
            run = max(1, GRID_CELLS // max(1, half.size))  # widths that share a block
            for j in range(0, len(gammas), run):
                found = np.exp(half / (gammas[j:j + run, None, None] ** 2)) @ votes[kat[i]:kat[i + 1]]
                totals[out, j:j + run], positives[out, j:j + run] = found[:, :, 0].T, found[:, :, 1].T
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[start:end], np.diff(at[start:end + 1]))), pa.array(x[at[start]:at[end]]), packed(totals), packed(positives)],
                                         names=["appid", "x", "total", "positive"])
        start = end


def kernel_sums(asked: DataFrame, histogram: DataFrame, widths: Sequence[float]) -> DataFrame:
    """For every asked (appid, x): summed weights and positive weights per kernel width.

    Columns ``appid``, ``x``, ``total`` and ``positive`` (arrays over ``widths``).
    """
    gammas = np.asarray(widths, dtype=float)
    points = asked.select("appid", "x").distinct()
    # a row an item for both sides: else every join down to the blocks is by item, and Spark keeps all their sorts in one task
    both = histogram.select("appid", F.lit(1).alias("k"), F.lit(0).alias("a")).unionByName(points.select("appid", F.lit(0).alias("k"), F.lit(1).alias("a")))
    sizes = both.groupBy("appid").agg(_parts(F.sum("k")).alias("_k"), _parts(F.sum("a")).alias("_a")).filter("_k > 0 and _a > 0")
    known = _chunks(histogram, sizes.drop("_a"), "_k", ["x", "n", "up"]).select(
        "appid", F.col("chunk").alias("_other"), F.col("x").alias("kx"), F.col("n").alias("kn"), F.col("up").alias("kup"))
    wanted = _chunks(points, sizes, "_a", ["x"])
    routed = wanted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select("appid", "x", "_other")
    blocks = routed.join(known, ["appid", "_other"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from weighted_votes(batch, gammas)

    sums = blocks.select("appid", "x", "kx", "kn", "kup").mapInArrow(work, "appid long, x double, total array<double>, positive array<double>")

    def add(column: str) -> Column:
        return F.array(*[F.sum(F.col(column)[i]) for i in range(len(gammas))]).alias(column)

    return sums.groupBy("appid", "x").agg(add("total"), add("positive"))


def vote_probability(asked: DataFrame, histogram: DataFrame, rate: Column, width: float = KERNEL_WIDTH, prior: float = KERNEL_PRIOR) -> DataFrame:
    """Chance of a positive vote at each asked (appid, x)."""
    sums = kernel_sums(asked, histogram, [width])
    return sums.withColumn("_a", rate).select("appid", "x", ((F.col("positive")[0] + prior * F.col("_a")) / (F.col("total")[0] + prior)).alias("p_plus"))


def leave_one_out(histogram: DataFrame, rate: Column, width: float = KERNEL_WIDTH, prior: float = KERNEL_PRIOR) -> DataFrame:
    """Each review predicted from the item's other reviews. Reviews of equal playtime and vote share a row (``n``)."""
    joined = kernel_sums(histogram, histogram, [width]).join(histogram, ["appid", "x"]).withColumn("_a", rate)
    both = joined.select("appid", "x", "_a", F.col("total")[0].alias("t"), F.col("positive")[0].alias("p"), F.inline(F.array(
        F.struct(F.lit(True).alias("voted_up"), F.col("up").alias("n")), F.struct(F.lit(False).alias("voted_up"), (F.col("n") - F.col("up")).alias("n")))))
    own = F.when(F.col("voted_up"), 1.0).otherwise(0.0)
    return both.filter("n > 0").select("appid", "x", "voted_up", F.col("n").cast("long").alias("n"),
                                       ((F.col("p") - own + prior * F.col("_a")) / F.greatest(F.col("t") - 1.0 + prior, F.lit(1e-12))).alias("p_plus"))


FACTORS = 8


def log_powers(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums by column of ``count`` times the log of ``x``, rows by falling count; ``x`` is at least 1e-12 and overwritten.

    A log costs many times a product, so up to 16 factors share one: 1e-12 ** 16 is still a normal number.
    """
    many = int(np.searchsorted(-count, -FACTORS))  # rows counted more often than that
    single = int(np.searchsorted(-count, -1.0))
    if (count != np.floor(count)).any():
        many = single = len(count)
    out = count[:many] @ np.log(x[:many]) if many else np.zeros(x.shape[1])
    few, once = x[many:single], x[single:]
    own = few.copy()
    for k in range(2, FACTORS + 1):
        end = int(np.searchsorted(-count[many:single], -k, side="right"))
        own[:end] *= few[:end]
    return out + _folded(own, 1) + _folded(once, 4)


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """Sums by column of the logs of ``x``, of products of at most 2 ** ``times`` rows each; ``x`` is overwritten."""
    for _ in range(times):
        half = (len(x) + 1) // 2
        x[:len(x) - half] *= x[half:]
        x = x[:half]
    return np.log(x).sum(axis=0)


def likelihood_grid(histogram: DataFrame, rate: float, widths: Sequence[float], priors: Sequence[float], least: int = 2) -> DataFrame:
    """Leave-one-out log-likelihood of all reviews for every (width, prior weight)."""
    sizes = histogram.groupBy("appid").agg(F.sum("n").alias("_n"), _parts(F.count("*")).alias("parts")).filter(F.col("_n") >= least).drop("_n")
    gammas, strengths = np.asarray([float(w) for w in widths]), np.asarray(priors, dtype=float)
    # the sums of an item in one chunk never leave the task that works them out
    short = _chunks(histogram, sizes.filter("parts = 1"), "parts", ["x", "n", "up"]).select("appid", "x", F.col("x").alias("kx"), F.col("n").alias("kn"), F.col("up").alias("kup"))
    short = short.repartition(parallelism(histogram), F.xxhash64("appid"))  # few bytes, much work: sized by bytes, one task would get it all
    long = histogram.join(sizes.filter("parts > 1"), "appid", "left_semi")
    sums = kernel_sums(long, long, widths).join(long, ["appid", "x"]).select("total", "positive", "n", "up")

    def add(ll: np.ndarray, total: np.ndarray, p: np.ndarray, n: np.ndarray, up: np.ndarray) -> None:
        rows = max(1, GRID_CELLS // len(gammas))
        for at in range(0, len(total), rows):
            own = slice(at, at + rows)
            for sign, count in ((1, up[own]), (-1, (n - up)[own])):
                some = np.flatnonzero(count != 0)
                some = some[np.argsort(-count[some], kind="stable")]
                c, t, known = count[some], total[own][some] - 1.0, p[own][some] - (1.0 if sign > 0 else 0.0)
                for j, s in enumerate(strengths):
                    base = np.maximum(t + s, 1e-12)
                    share = known + s * rate
                    if sign < 0:
                        share = base - share
                    share /= base
                    ll[:, j] += log_powers(np.clip(share, 1e-12, 1 - 1e-12, out=share), c)

    def told(ll: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(float(g), float(s), ll[i, j]) for i, g in enumerate(gammas) for j, s in enumerate(strengths)], columns=["width", "prior", "log_likelihood"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ll = np.zeros((len(gammas), len(strengths)))
        for batch in batches:
            if len(batch):
                add(ll, np.stack(batch["total"].to_numpy()), np.stack(batch["positive"].to_numpy()), batch["n"].to_numpy(), batch["up"].to_numpy())
        yield told(ll)

    def fold_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll = np.zeros((len(gammas), len(strengths)))
        for batch in batches:
            n, up = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            at = 0
            for found in weighted_votes(batch, gammas):
                total, positive = (found.column(i).flatten().to_numpy().reshape(-1, len(gammas)) for i in (2, 3))
                add(ll, total, positive, n[at:at + len(total)], up[at:at + len(total)])
                at += len(total)
        yield pa.RecordBatch.from_pandas(told(ll), preserve_index=False)

    shape = "width double, prior double, log_likelihood double"
    parts = sums.mapInPandas(fold, shape).unionByName(short.mapInArrow(fold_items, shape))
    return parts.groupBy("width", "prior").agg(F.sum("log_likelihood").alias("log_likelihood"))


def best_parameters(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max_by(F.struct("width", "prior", "log_likelihood"), F.struct("log_likelihood", -F.col("width"), -F.col("prior"))).alias("b")).select("b.*")


def response_curve(histogram: DataFrame, rate: Column, playtimes: Sequence[float], width: float = KERNEL_WIDTH, prior: float = KERNEL_PRIOR) -> DataFrame:
    """Chance of a positive vote of every item at hypothetical playtimes."""
    points = F.array(*[F.lit(float(p)) for p in playtimes])
    return vote_probability(histogram.select("appid").distinct().withColumn("x", F.explode(points)), histogram, rate, width, prior)


def soft_labels(library: DataFrame, items: DataFrame, reviews: DataFrame, rate: Column, strength: float = 2000.0,
                slope: float | None = None, intercept: float | None = None) -> DataFrame:
    """Predicted rating of every library row (user_id, appid, playtime, user_voted_up) from quality and playtime.

    An own vote is a hard 1 or 0, an item without reviews keeps its smoothed rate, an unplayed item is a neutral 5.
    """
    owned = library.join(items.select("appid", "positive", "negative"), "appid").withColumn("_a", rate)
    scored = owned.withColumn("global_p", smoothed_rate(strength, F.col("_a"))).withColumn("global_q", normal.quantile("global_p"))
    asked = library.filter((F.col("playtime") > 0) & F.col("user_voted_up").isNull()).select("appid", F.col("playtime").alias("x"))
    histogram = vote_histogram(reviews)  # items nobody asks for go where the items' sizes meet
    chances = vote_probability(asked, histogram, rate).withColumnRenamed("x", "playtime")
    joined = scored.join(chances, ["appid", "playtime"], "left")
    unplayed = F.col("playtime") <= 0
    p = (F.when(unplayed, F.col("global_p")).when(F.col("user_voted_up"), F.lit(1.0)).when(~F.col("user_voted_up"), F.lit(0.0))
         .otherwise(F.coalesce("p_plus", "global_p")))
    out = personalized_quality(joined.withColumn("p_plus", p), "global_q", "p_plus")
    out = out.withColumn("personalized_q", F.when(unplayed, F.col("global_q")).otherwise(F.col("personalized_q")))
    scale = {k: v for k, v in (("slope", slope), ("intercept", intercept)) if v is not None}
    return out.withColumns({"predicted_rating": F.when(unplayed, F.lit(5)).otherwise(rating_of(F.col("personalized_q"), **scale)),
                            "has_playtime": ~unplayed}).drop("_a", "positive", "negative", "global_p")


# ----------------------------------------------------------------------------- how far to trust a small sample's median


def size_class(count: Column) -> Column:
    """An odd sample size that stands for a count: the count itself up to 32, about eight classes an octave beyond."""
    class_ = F.when(count <= 32, count.cast("double")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(count.cast("double")) * 8 + F.lit(1e-9)) / 8) + F.lit(1e-9)))
    return (F.floor(class_ / 2) * 2 + 1).cast("long")


@F.pandas_udf(T.DoubleType())
def _median_share(low: pd.Series, high: pd.Series, size: pd.Series) -> pd.Series:
    """Chance that the median of ``size`` draws falls between two cumulative shares (an order statistic's beta law)."""
    h = (size.to_numpy(float) + 1) / 2
    return pd.Series(incomplete_beta(high.to_numpy(float), h, h) - incomplete_beta(low.to_numpy(float), h, h))


def median_moments(histogram: DataFrame, least: int = 80) -> DataFrame:
    """First and second moment of the logged sample median of every well reviewed item at every realistic sample size.

    Columns ``appid``, ``size``, ``weight`` (share of all items with that size), ``true_log``, ``first``, ``second``. ``histogram`` holds positive votes per playtime. The
    law is exact: the middle one of ``size`` draws with replacement is at most x with the chance I_F(x)(h, h), h = (size + 1) / 2, so no sample is
    drawn. Sizes are odd (``size_class``), at most a few hundred, and come from the counts of all items.
    """
    counts = histogram.groupBy("appid").agg(F.sum("n").cast("long").alias("total"))
    classes = counts.withColumn("size", size_class(F.col("total"))).groupBy("size").agg(F.count("*").alias("c"))
    sizes = classes.agg(F.collect_list(F.struct("size", (F.col("c") / F.lit(1.0)).alias("c"))).alias("x")).scalar()
    reliable = counts.filter(F.col("total") >= least)
    medians = group_percentiles(histogram.join(reliable.select("appid"), "appid", "left_semi"), ["appid"], "x", {"median": 0.5}, "n")
    run = F.sum("n").over(W.partitionBy("appid").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    levels = histogram.select("appid", "x", "n").join(reliable, "appid").withColumn("run", run)
    shares = levels.select("appid", F.log1p("x").alias("y"), ((F.col("run") - F.col("n")) / F.col("total")).alias("low"), (F.col("run") / F.col("total")).alias("high"))
    spread = shares.withColumn("_s", sizes).withColumn("all", F.aggregate("_s", F.lit(0.0), lambda a, e: a + e["c"])).select("appid", "y", "low", "high", "all", F.inline("_s"))
    chance = spread.withColumn("p", _median_share("low", "high", "size"))
    moments = chance.groupBy("appid", "size").agg((F.first("c") / F.first("all")).alias("weight"), F.sum(F.col("y") * F.col("p")).alias("first"), F.sum(F.col("y") * F.col("y") * F.col("p")).alias("second"))
    return moments.join(medians.select("appid", F.log1p("median").alias("true_log")), "appid")


def strength_loss(moments: DataFrame, prior: Column, grid: Sequence[float]) -> DataFrame:
    """Expected squared error of shrunken sample medians for every strength in the grid, mean over items, by size weights."""
    spread = moments.withColumn("_m", prior).withColumn("strength", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    n, c, m, t = (F.col(x) for x in ("size", "strength", "_m", "true_log"))
    mean = (n * F.col("first") + c * m) / (n + c)
    square = (n * n * F.col("second") + 2 * n * c * m * F.col("first") + c * c * m * m) / ((n + c) * (n + c))
    return spread.groupBy("strength").agg((F.sum(F.col("weight") * (square - 2 * t * mean + t * t)) / F.sum("weight")).alias("loss"))


def median_prior(moments: DataFrame) -> Column:
    """Mean of the logged medians of the well reviewed items."""
    return moments.groupBy("appid").agg(F.first("true_log").alias("t")).agg(F.avg("t").alias("x")).scalar()


def playtime_strength(histogram: DataFrame, least: int = 80, low: float = 0.1, high: float = 5000.0, points: int = 41, rounds: int = 3) -> float:
    """Shrinkage of median playtimes: a logarithmic grid, refined around its best point; 100 where no item is well reviewed."""
    moments = checkpointed(median_moments(histogram, least))
    if moments.isEmpty():
        return 100.0
    prior, best = median_prior(moments), low
    for _ in range(rounds):
        grid = np.geomspace(low, high, points)
        best = strength_loss(moments, prior, grid).agg(F.min_by("strength", F.struct("loss", "strength")).alias("b")).first()["b"]
        step = (high / low) ** (1 / (points - 1))
        low, high = max(0.1, best / step), min(5000.0, best * step)
    return float(best)
