"""Predicted difficulty of every item from titles that match a rated list, tag profiles and topics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.normal import quantile
from curatrix.operators import joins, regression, wide
from curatrix.operators.normalize import value_ranks
from curatrix.session import checkpointed

ALPHAS = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)


def labels(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """(appid, difficulty) from (title, difficulty on 1 to 5): titles are averaged, scaled to 0 to 10 and matched to names."""
    means = ratings.filter(F.col("difficulty").isNotNull()).groupBy("title").agg(((F.avg("difficulty") - 1.0) * 2.5).alias("difficulty"))
    found = joins.match_titles(means, items)
    return found.join(means, "title").select("appid", "difficulty")


def rank_normal_vectors(df: DataFrame, vector: str, dims: int, key: str = "appid", offset: float = 0.375) -> DataFrame:
    """Every dimension of a vector column as normal scores of its ranks; a constant dimension is 0. One row an item, as before."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x"))
    ranks = value_ranks(long, "x", ["dim"])
    levels = ranks.groupBy("dim").agg(F.count("*").alias("levels"))
    shares = ranks.join(levels, "dim").withColumn("_p", (F.col("rank_avg") - offset) / (F.col("n") - 2 * offset + 1))
    scored = shares.select("dim", "x", F.when(F.col("levels") > 1, quantile("_p")).otherwise(0.0).alias("z"))
    entries = long.join(scored, ["dim", "x"]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda e: e["z"]).alias(vector))
    return entries.filter(F.size(vector) == dims)


def difficulty_model(features: DataFrame, labelled: DataFrame, names: Sequence[str], alphas: Sequence[float] = ALPHAS, folds: int = 5, neutral: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(appid, difficulty_predicted) of every item and the non-zero (feature, coefficient), from ``features`` (appid, vec) and ``labelled`` (appid, difficulty).

    Features become normal scores over all items; the L1 penalty with the smallest mean error over the folds is refitted on all labels;
    predictions stay within 0 to 10. Without labels every item is neutral.
    """
    spark, dims = features.sparkSession, len(names)
    rows = checkpointed(rank_normal_vectors(features, "vec", dims))
    known = checkpointed(rows.join(labelled, "appid").withColumn("fold", regression.fold_of(F.col("appid"), folds)))
    n = known.count()
    if not n:
        return rows.select("appid", F.lit(neutral).alias("difficulty_predicted")), spark.createDataFrame([], "feature string, coefficient double")
    errors = {}
    for alpha in alphas:
        total = 0.0
        for fold in range(folds):
            train, test = known.filter(F.col("fold") != fold), known.filter(F.col("fold") == fold)
            level, beta = wide.wide_lasso(train, "vec", "difficulty", dims, alpha)
            gap = F.col("difficulty") - F.col("predicted")
            total += wide.wide_predict(test, "vec", level, beta).agg(F.sum(gap * gap)).first()[0] or 0.0
        errors[alpha] = total / n
    best = min(errors, key=lambda a: (errors[a], -a))
    level, beta = wide.wide_lasso(known, "vec", "difficulty", dims, best)
    predicted = wide.wide_predict(rows, "vec", level, beta).select("appid", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("predicted"))).alias("difficulty_predicted"))
    used = [(names[i], float(beta[i])) for i in np.flatnonzero(beta)]
    return predicted, spark.createDataFrame(sorted(used, key=lambda f: (-f[1], f[0])), "feature string, coefficient double")
