"""Row filters and derived flags of the item table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.dates import is_unreleased
from curatrix.functions.text import parse_list, parse_vote_map


def first_per_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order``; combined on the map side, so a hot key costs no sort."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_row"))
    return picked.select(key, "_row.*")


def preclean(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Catalogue rows worth keeping: no add-ons, one per id, id and name known, tags never null."""
    kept = df.filter(~F.coalesce(F.col("is_dlc"), F.lit(False)) & F.col("appid").isNotNull())
    return first_per_key(kept, "appid", order).filter(F.col("name").isNotNull()).na.fill("{}", ["tags"])


def with_flags(df: DataFrame) -> DataFrame:
    """Item flags from raw texts. With no language text at all, every item counts as English."""
    any_language = df.agg(F.coalesce(F.max(F.length(F.col("languages")) > 0), F.lit(False)).alias("x")).scalar()
    lower = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("categories", "languages", "tags", "price", "name")}
    return df.withColumns({
        "is_vr_only": lower["categories"].contains("vr only"),
        "is_english": ~any_language | lower["languages"].contains("english"),
        "is_utility": lower["tags"].contains("utilities"),
        "is_nsfw": (F.col("mature_content") > 0) | lower["tags"].contains("'hentai':"),
        "is_delisted": lower["price"].contains("delisted") | lower["name"].contains("delisted"),
        "is_hollow": ((F.length(F.coalesce(F.col("short_description"), F.lit(""))) < 10)
                      & (F.coalesce(F.col("tags"), F.lit("")) == "{}") & (F.coalesce(F.col("genres"), F.lit("")) == "")),
    })


def apply_delisting_checks(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Mark items that the page checks found gone, and their price text with them."""
    gone = (checks.filter((~F.col("has_action_button") & ~F.col("is_coming_soon")) | F.col("is_delisted_kw"))
            .select("appid").distinct().withColumn("_gone", F.lit(True)))
    joined = items.join(gone, "appid", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    return joined.withColumns({
        "is_delisted": F.col("is_delisted") | F.col("_gone"),
        "price": F.when(F.col("_gone"), F.lit("Delisted")).otherwise(F.col("price"))}).drop("_gone")


def eligible(*, english_only: bool = False, remove_vr: bool = False, remove_utilities: bool = False,
             remove_delisted: bool = False, remove_hollow: bool = False, remove_nsfw: bool = False,
             unreleased_after: dt.datetime | None = None) -> Column:
    """The base predicate behind the six request switches."""
    keep = F.lit(True)
    if english_only:
        keep = keep & F.col("is_english")
    for switch, flag in ((remove_vr, "is_vr_only"), (remove_utilities, "is_utility"), (remove_delisted, "is_delisted"),
                         (remove_hollow, "is_hollow"), (remove_nsfw, "is_nsfw")):
        if switch:
            keep = keep & ~F.col(flag)
    if unreleased_after is not None:
        keep = keep & ~is_unreleased(F.col("parsed_date"), F.col("release_date"), unreleased_after)
    return keep


def has_reviews() -> Column:
    return (F.col("positive") + F.col("negative")) > 0


def any_genre(wanted: Sequence[str], column: str = "genres") -> Column:
    """Any wanted genre occurs in the genre text, letter case ignored."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    hit = F.lit(False)
    for genre in wanted:
        hit = hit | text.contains(genre.lower())
    return hit


def all_tags(wanted: Sequence[str], tag_map: Column) -> Column:
    hit = F.lit(True)
    for tag in wanted:
        hit = hit & F.map_contains_key(tag_map, tag)
    return hit


def include_exclude(tags: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Every included tag and none of the excluded ones."""
    keep = F.lit(True)
    for tag in include:
        keep = keep & F.array_contains(tags, tag)
    for tag in exclude:
        keep = keep & ~F.array_contains(tags, tag)
    return keep


def quality_gate(min_reviews: int = 63, min_share: float = 0.65) -> Column:
    total = F.col("positive") + F.col("negative")
    return ((total >= min_reviews) & (F.col("positive") / (total + F.lit(1e-9)) >= min_share)
            & ~F.col("is_hollow") & ~F.col("is_delisted") & ~F.col("is_utility") & ~F.col("is_nsfw"))


def gate_penalty(gate: Column, penalty: float = 0.4) -> Column:
    return F.when(gate, F.lit(0.0)).otherwise(F.lit(-penalty))


def exclude_profile(items: DataFrame, library: DataFrame, mode: str, ignored: DataFrame | None = None) -> DataFrame:
    """Leave out what a user has: ``none``, ``rated``, ``all`` or ``completed`` (rated or played)."""
    modes = {"none": F.lit(False), "all": F.lit(True), "rated": F.col("rated"),
             "completed": F.col("rated") | (F.col("playtime") > 0)}
    out = items if mode == "none" else items.join(library.filter(modes[mode]).select("appid"), "appid", "left_anti")
    return out if ignored is None else out.join(ignored.select("appid"), "appid", "left_anti")


def reliable_or_all(df: DataFrame, reliable: Column, fallback: Column) -> DataFrame:
    """Rows that pass ``reliable``; when none does, those that pass ``fallback``. One scan for the test."""
    some = df.agg(F.coalesce(F.bool_or(reliable), F.lit(False)).alias("x")).scalar()
    return df.filter(F.when(some, reliable).otherwise(fallback))


def keep_validated_tags(tag_map: Column, validated: Column) -> Column:
    """Drop tags that are not in the validated set from a vote map."""
    return F.map_filter(tag_map, lambda k, _: F.array_contains(validated, k))


def tag_map(column: str = "tags") -> Column:
    return parse_vote_map(F.col(column))


def genre_array(column: str = "genres") -> Column:
    return parse_list(F.col(column))
