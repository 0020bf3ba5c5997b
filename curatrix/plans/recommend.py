"""Filtered, scored and explained recommendation in one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators import bayes, filters
from curatrix.operators import kernel as K
from curatrix.operators.normalize import to_z
from curatrix.session import checkpointed

CLAMP = (-8.0, 8.0)
# Scale and penalty of text, tag and topic directions; natural range of topic similarity.
TEXT_SCALE, TEXT_PENALTY, TAG_SCALE, TAG_PENALTY, TOPIC_SCALE = 2.0, 0.1, 1.0, 0.5, 26.5
TOPIC_MEAN, TOPIC_STD = 0.84609, 0.03022
VETO = 20.0
Z_SOURCES = {"q": "z_quality", "date_z": "z_date", "pop_z": "z_pop", "playtime_z": "z_length", "difficulty_z": "z_difficulty", "price_z": "z_price"}


@dataclass(frozen=True)
class Request:
    """What a caller asks for. Weights follow their names; ``coefficients`` switches to the learned linear mode."""

    top_k: int = 50
    seeds: tuple[int, ...] = ()
    genres: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    semantic: float = 1.0
    tag: float = 1.0
    topic: float = 0.0
    quality: float = 1.0
    age: float = 0.0
    popularity: float = 0.0
    length: float = 0.0
    difficulty: float = 0.0
    price: float = 0.0
    difficulty_similarity: float = 0.0
    tone_similarity: float = 0.0
    discovery: float = 0.0
    prompt_vector: tuple[float, ...] | None = None
    prompt_topics: tuple[float, ...] | None = None
    taste_tags: tuple[float, ...] | None = None
    taste_text: tuple[float, ...] | None = None
    taste_topics: tuple[float, ...] | None = None
    coefficients: dict[str, float] | None = None
    group_coefficients: dict[str, float] = field(default_factory=dict)
    topic_coefficients: tuple[float, ...] = ()
    intercept: float = 5.0
    switches: dict[str, bool] = field(default_factory=dict)
    unreleased_after: dt.datetime | None = None
    profile_filter: str = "none"
    semantic_mean: float = 0.0


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _blend(signals: list[Column]) -> Column:
    if not signals:
        return F.lit(0.0)
    return signals[0] if len(signals) == 1 else V.softmin_blend(F.array(*signals))


def signals(items: DataFrame, request: Request, seeded: bool) -> DataFrame:
    """Text, tag and topic signals of every item: each a softmin of what the request brings."""
    text = [F.col("theme")] if seeded else []
    tag = [F.col("vibe")] if seeded else []
    topic = [F.col("topic_sim")] if seeded else []
    for direction in (request.prompt_vector, request.taste_text):
        if direction is not None:
            text.append(V.one_sided_cosine(F.col("vec"), _array(direction), TEXT_PENALTY, TEXT_SCALE))
    if request.taste_tags is not None:
        tag.append(V.one_sided_cosine(F.col("verbs"), _array(request.taste_tags), TAG_PENALTY, TAG_SCALE))
    if request.prompt_topics is not None:
        topic.append(V.jensen_shannon_similarity(_array(request.prompt_topics), F.col("topics"), TOPIC_MEAN, TOPIC_STD))
    if request.taste_topics is not None:
        topic.append(V.dot(F.col("topics"), _array(request.taste_topics)) * TOPIC_SCALE)
    return items.withColumns({"semantic_sim": F.when(F.col("is_hollow"), F.lit(0.0)).otherwise(_blend(text)), "tag_sim": _blend(tag), "topic_signal": _blend(topic)})


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(CLAMP[0]), F.least(F.lit(CLAMP[1]), c))


def manual_score(request: Request, seeded: bool) -> Column:
    """Weighted signals around a neutral 5; what the seed kernel rules out falls far down."""
    r = request
    total = (F.col("semantic_sim") * r.semantic + _clip(F.col("tag_sim")) * r.tag + _clip(F.col("topic_signal")) * r.topic
             + F.col("z_quality") * r.quality + F.col("z_date") * r.age + F.col("z_pop") * r.popularity + F.col("z_length") * r.length
             + F.col("z_difficulty") * r.difficulty + F.col("z_price") * r.price + F.lit(5.0))
    if seeded:
        total = total + F.col("difficulty") * r.difficulty_similarity + F.col("tone") * r.tone_similarity
        total = total - F.when(F.col("kernel") < 1e-6, F.lit(VETO)).otherwise(F.lit(0.0))
    return total


def linear_score(request: Request, seeded: bool) -> Column:
    """Learned coefficients on rating features, z-scores, identity groups and topics (``x_*`` columns)."""
    total = F.lit(request.intercept)
    for name, weight in (request.coefficients or {}).items():
        total = total + F.coalesce(F.col(f"x_{name}"), F.lit(0.0)) * weight
    for group, weight in request.group_coefficients.items():
        total = total + F.when(F.array_contains("groups", group), F.lit(float(weight))).otherwise(F.lit(0.0))
    if request.topic_coefficients:
        total = total + V.dot(F.col("topics"), _array(request.topic_coefficients))
    if seeded:
        total = total + F.col("difficulty") * request.difficulty_similarity + F.col("tone") * request.tone_similarity
    return total


def eligible_pool(items: DataFrame, request: Request) -> DataFrame:
    linear = request.coefficients is not None
    wanted = {"english_only", "remove_vr", "remove_utilities", "remove_delisted"}
    switches = {s: bool(request.switches.get(s)) or linear for s in wanted}
    switches |= {"remove_hollow": linear, "remove_nsfw": bool(request.switches.get("remove_nsfw"))}
    keep = filters.eligible(**switches, unreleased_after=request.unreleased_after) & filters.has_reviews()
    if request.genres:
        keep = keep & filters.any_genre(request.genres)
    for tag in request.tags:
        keep = keep & F.array_contains("tag_set", tag)
    return items.filter(keep)


def score_pool(items: DataFrame, grid: DataFrame, request: Request, taxonomy: K.Taxonomy, soul_tags: DataFrame,
               library: DataFrame | None = None, ignored: DataFrame | None = None, rating_features: DataFrame | None = None) -> DataFrame:
    """Every eligible item with its ``score`` and the values behind it; arguments as in ``recommend``."""
    seed = K.merge_seed(items, request.seeds, soul_tags, taxonomy) if request.seeds else None
    seeded = seed is not None
    rows = K.seed_kernel(items, seed, taxonomy) if seeded else items.withColumn("kernel", F.lit(None).cast("double"))
    step = grid.filter(F.col("step") == bayes.grid_step(request.discovery)).select("appid", "q")
    rows = signals(rows, request, seeded).join(step, "appid")
    if library is not None and "p_plus" in library.columns:
        rows = bayes.personalize_owned(rows, library.filter("p_plus IS NOT NULL"))
    else:
        rows = rows.withColumn("is_personalized", F.lit(False))
    if request.coefficients is not None:
        everywhere = {"q": "x_quality", "date_z": "x_age", "pop_z": "x_popularity", "playtime_z": "x_length", "difficulty_z": "x_difficulty",
                      "price_z": "x_price", "tone_z": "x_tone"}
        rows = to_z(checkpointed(rows), everywhere, clamp=CLAMP)
        rows = rows.join(rating_features, "appid", "left") if rating_features is not None else rows
        for c in ("x_kernel", "x_graph"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(0.0))
    # moments and rows are two passes: all before them is worked out once
    pool = to_z(checkpointed(eligible_pool(rows, request)), Z_SOURCES, clamp=CLAMP)
    score = linear_score(request, seeded) if request.coefficients is not None else manual_score(request, seeded)
    scored = pool.withColumn("score", score)
    if seeded:
        scored = scored.filter(~F.col("appid").isin(list(seed.ids)))
    if library is not None:
        scored = filters.exclude_profile(scored, library, request.profile_filter, ignored)
    return scored


def recommend(items: DataFrame, grid: DataFrame, request: Request, taxonomy: K.Taxonomy, soul_tags: DataFrame,
              library: DataFrame | None = None, ignored: DataFrame | None = None, rating_features: DataFrame | None = None,
              natural: DataFrame | None = None) -> DataFrame:
    """The top ``top_k`` items with score, match percent and every value behind it.

    ``grid`` is the quality grid (step, appid, q); ``library`` one user's rows (appid, rated, playtime, p_plus);
    ``rating_features`` (appid, x_kernel, x_graph) serve the linear mode; ``natural`` (appid, natural_q) places
    scores on the scale of positive votes. The kernel sees every item; z-scores see the filtered pool.
    """
    grid = checkpointed(grid.filter(F.col("step") == bayes.grid_step(request.discovery)))  # the score and the curve read it
    scored = score_pool(items, grid, request, taxonomy, soul_tags, library, ignored, rating_features)
    seeded = "theme" in scored.columns
    top = scored.orderBy(F.desc("score"), "name", "appid").limit(request.top_k)
    if natural is not None:
        weight = request.coefficients.get("quality", 0.0) if request.coefficients is not None else request.quality
        shown = seeded or request.prompt_vector is not None or request.taste_text is not None
        neutral = 5.0 + (request.semantic_mean * request.semantic if shown else 0.0)
        curve = grid.join(natural, "appid").select(F.col("q").alias("cx"), F.col("natural_q").alias("cy"))
        top = bayes.match_percent(top, "score", curve, weight, neutral)
    else:
        top = top.withColumn("match_percent", F.lit(None).cast("double"))
    r = request
    explained = {"w_quality": r.quality, "w_date": r.age, "w_pop": r.popularity, "w_length": r.length, "w_difficulty": r.difficulty, "w_price": r.price,
                 "w_semantic": r.semantic, "w_tag": r.tag, "w_tone": r.tone_similarity}
    out = top.withColumns({n: F.lit(float(v)) for n, v in explained.items()}).withColumns({
        "weighted_score": F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("score"))), "raw_pop": (F.col("positive") + F.col("negative")).cast("long"),
        "z_tone": F.col("tone") if seeded else F.lit(0.0)})
    columns = ["appid", "name", "score", "weighted_score", "match_percent", "is_personalized", "semantic_sim", "tag_sim", "topic_signal", *Z_SOURCES.values(),
               "z_tone", *explained, "raw_pop"]
    return out.select(*columns).orderBy(F.desc("score"), "name", "appid")


def rerank(pool: DataFrame, weights: dict[str, float], intercept: float, kernel: DataFrame | None = None, near: int | None = None,
           include: Sequence[str] = (), exclude: Sequence[str] = (), k: int = 100) -> DataFrame:
    """Interactive re-ranking of a stored pool: nearest to seeds, tag rules, new weights, clipped to 0..10."""
    rows = pool
    if kernel is not None and near is not None:
        rows = rows.join(kernel.select("appid", "similarity"), "appid", "left").na.fill(0.0, ["similarity"]).orderBy(F.desc("similarity"), "appid").limit(near)
    rows = rows.filter(filters.include_exclude(F.col("tag_set"), include, exclude))
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    scored = rows.withColumn("current_score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)))
    return scored.orderBy(F.desc("current_score"), "appid").limit(k)
