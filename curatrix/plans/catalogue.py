"""The item table from raw rows, reviews and difficulty predictions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.dates import parse_release_date
from curatrix.functions.money import parse_price
from curatrix.functions.text import repair_number
from curatrix.operators import aggregates, bayes, filters, joins, normalize

COLUMNS = ("appid", "name", "short_description", "genres", "tags", "categories", "languages", "release_date", "parsed_date", "positive", "negative",
           "mature_content", "price", "price_numeric", "date_z", "pop_z", "median_playtime", "playtime_z", "estimated_playtime", "release_year",
           "difficulty_predicted", "difficulty_z", "price_z", "is_vr_only", "is_english", "is_utility", "is_nsfw", "is_delisted", "is_hollow")


def build_items(raw: DataFrame, reviews: DataFrame, as_of: dt.date, order: Sequence[str], difficulty: DataFrame | None = None,
                checks: DataFrame | None = None) -> DataFrame:
    """Clean rows, parse dates and prices, count and average reviews, score and flag.

    Every statistic is one aggregate over the item table; the review table is read once.
    """
    items = filters.preclean(raw, order).withColumn("parsed_date", parse_release_date(F.col("release_date"), as_of))
    items = items.withColumns({c: repair_number(F.col(c)).cast("long") for c in ("positive", "negative")})
    items = normalize.date_z(normalize.year_or_mean(items), as_of)
    stats = aggregates.review_stats(reviews)
    items = joins.with_review_counts(items, stats).join(stats.select("appid", "median_playtime", "review_count"), "appid", "left")
    items = normalize.popularity_z(bayes.playtime_estimates(items))
    items = normalize.price_z(items.withColumn("price_numeric", parse_price(F.col("price"))))
    if difficulty is None:
        items = items.withColumns({"difficulty_predicted": F.lit(5.0), "difficulty_z": F.lit(0.0)})
    else:
        items = normalize.difficulty_z(items, difficulty, ~F.col("tags").isin("{}", "[]", ""))
    items = filters.with_flags(items)
    if checks is not None:
        items = filters.apply_delisting_checks(items, checks)
    texts = ("short_description", "genres", "tags", "categories", "languages", "release_date", "price")
    return items.na.fill("", list(texts)).select(*COLUMNS)
