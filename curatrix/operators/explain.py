"""Reading vectors back: tags of a dimension, word labels, ideal profiles, motivations, topics, tone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators import matrix, pairs
from curatrix.operators.toplists import top_k_by_group
from curatrix.session import checkpointed


def weights_as_rows(spark, names: Sequence[str], weights: np.ndarray) -> DataFrame:
    """A tags x dimensions matrix as one vector per tag (tags x dims numbers)."""
    rows = [(i, n, [float(x) for x in w]) for i, (n, w) in enumerate(zip(names, weights))]
    return spark.createDataFrame(rows, "appid long, tag string, vec array<double>")


def dimension_tags(weights: DataFrame, tag_counts: DataFrame, k: int = 10, least: int = 500) -> DataFrame:
    """Strongest tags per dimension on either side, among tags used often enough (columns ``tag``, ``vec``)."""
    common = weights.join(tag_counts.filter(F.col("items") >= least).select("tag"), "tag", "left_semi")
    long = common.select("tag", F.posexplode("vec").alias("dim", "w"))
    sides = long.filter("w <> 0").withColumn("side", F.when(F.col("w") > 0, "positive").otherwise("negative"))
    return top_k_by_group(sides, ["dim", "side"], [F.desc(F.abs("w")), F.asc("tag")], k)


def strongest_dimensions(taste: Sequence[float], weights: DataFrame, dims: int = 5, k: int = 5) -> DataFrame:
    """The user's strongest dimensions and the tags that contribute most to each in the user's direction."""
    order = sorted(range(len(taste)), key=lambda i: (-abs(taste[i]), i))[:dims]
    picked = weights.sparkSession.createDataFrame([(int(i), float(taste[i])) for i in order], "dim int, taste double")
    long = weights.select("tag", F.posexplode("vec").alias("dim", "w")).join(F.broadcast(picked), "dim")
    scored = long.withColumn("contribution", F.col("w") * F.col("taste"))
    return top_k_by_group(scored, ["dim"], [F.desc("contribution"), F.asc("tag")], k)


def search_by_taste(items: DataFrame, taste: Sequence[float], penalty: float, k: int = 20, mean_norm: Column | None = None) -> DataFrame:
    """Items along a taste direction, scaled to the mean vector length."""
    direction = np.asarray(taste) / max(np.linalg.norm(taste), 1e-9)
    factor = mean_norm if mean_norm is not None else F.lit(1.0)
    scored = items.withColumn("_f", factor).withColumn("score", V.one_sided_cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in direction]), penalty) * F.col("_f"))
    return scored.drop("_f").orderBy(F.desc("score"), "appid").limit(k)


def ideal_profile(spark, taste: Sequence[float], weights: np.ndarray, names: Sequence[str], prior: Sequence[float], k: int = 30) -> DataFrame:
    """Tags of the item a taste vector describes: back through the pseudo-inverse, off the log prior, normalized."""
    back = np.asarray(taste) @ np.linalg.pinv(weights) + np.log(np.asarray(prior) + 1e-9)
    share = np.exp(back - back.max())
    share /= share.sum()
    order = np.argsort(-share, kind="stable")[:k]
    return spark.createDataFrame([(r + 1, names[i], float(share[i])) for r, i in enumerate(order)], "rank int, tag string, share double")


def label_dimensions(words: DataFrame, dims: int, bag: int = 3) -> DataFrame:
    """Words whose summed vectors best point along each dimension, chosen greedily (columns ``word``, ``vec``).

    Every step looks at all words: it maximizes the share of the summed vector's length that lies on the dimension, for all
    dimensions in one pass. A dimension stops when no word raises its share. Only one row per dimension and step comes to the driver.
    """
    total, score = np.zeros((dims, dims)), np.full(dims, -np.inf)
    chosen: list[list[str]] = [[] for _ in range(dims)]
    for _ in range(bag):
        own, taken = total.copy(), [set(c) for c in chosen]

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                part = batch.sort_values("word")
                m, names = pairs.stack(part["vec"]), part["word"].to_numpy()
                length = np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] + 2 * m @ own.T, 1e-24))  # noqa: B023
                value = (m[:, :dims] + np.diag(own)[None, :]) / length  # noqa: B023
                for d, words_of in enumerate(taken):  # noqa: B023
                    value[np.isin(names, list(words_of)), d] = -np.inf
                at = value.argmax(axis=0)
                yield pd.DataFrame({"dim": np.arange(dims), "word": names[at], "vec": list(m[at]), "score": value[at, np.arange(dims)]})

        local = words.select("word", "vec").mapInPandas(step, "dim int, word string, vec array<double>, score double")
        for r in top_k_by_group(local, ["dim"], [F.desc(F.round("score", 12)), F.asc("word")], 1).collect():
            if len(chosen[r["dim"]]) == len(taken[r["dim"]]) and r["score"] > score[r["dim"]] and np.isfinite(r["score"]):
                score[r["dim"]] = r["score"]
                total[r["dim"]] += np.asarray(r["vec"])
                chosen[r["dim"]].append(r["word"])
        if all(len(c) == len(t) for c, t in zip(chosen, taken)):
            break
    rows = [(d, c, float(score[d])) for d, c in enumerate(chosen) if c]
    return words.sparkSession.createDataFrame(rows, "dim int, words array<string>, score double")


def label_pairs(words: DataFrame, difference: bool = True) -> DataFrame:
    """Best two of all words per dimension: their difference (opposites) or sum pointing along it; ties go to the smaller words."""
    sign = -1.0 if difference else 1.0

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (p.sort_values("word") for p in (a, b))
        m, k, first, second = pairs.stack(a["vec"]), pairs.stack(b["vec"]), a["word"].to_numpy(), b["word"].to_numpy()
        scale = 1 / np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (k * k).sum(axis=1)[None, :] + 2 * sign * (m @ k.T), 1e-12))
        scale[first[:, None] == second[None, :]] = np.nan
        found = []
        for d in range(m.shape[1]):
            value = (m[:, d, None] + sign * k[None, :, d]) * scale
            if not np.isnan(value).all():
                i, j = np.unravel_index(np.nanargmax(value), value.shape)
                found.append((d, first[i], second[j], float(value[i, j])))
        return pd.DataFrame(found, columns=["dim", "first", "second", "score"])

    local = pairs.pairwise(words.select("word", "vec"), words.select("word", "vec"), pick, "dim int, first string, second string, score double")
    return top_k_by_group(local, ["dim"], [F.desc(F.round("score", 12)), F.asc("first"), F.asc("second")], 1).drop("rank")


def motivation_scores(users: DataFrame, motives: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Category vectors against users' vectors, one cosine per modality (same column names on both sides), weighted."""
    def work(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = {c: pairs.similarity_block(pairs.stack(rows[c]), pairs.stack(known[c]), "cosine") for c in weights}
        total = sum(w * parts[c] for c, w in weights.items())
        return pd.DataFrame({"user_id": np.repeat(rows["user_id"].to_numpy(), len(known)), "motive": np.tile(known["motive"].to_numpy(), len(rows)), "score": total.ravel()})

    # both are counted before they are cut in pieces
    left, right = checkpointed(users.select("user_id", *weights)), checkpointed(motives.select("motive", *weights))
    return pairs.pairwise(left, right, work, "user_id long, motive string, score double")


def topic_motives(topics: DataFrame, motives: DataFrame) -> DataFrame:
    """Nearest category of every topic vector."""
    def work(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        s = pairs.similarity_block(pairs.stack(rows["vec"]), pairs.stack(known["vec"]), "cosine")
        best = s.argmax(axis=1)
        return pd.DataFrame({"topic": rows["topic"].to_numpy(), "motive": known["motive"].to_numpy()[best], "similarity": s[np.arange(len(s)), best]})

    local = pairs.pairwise(topics.select("topic", "vec"), motives.orderBy("motive").select("motive", "vec"), work, "topic long, motive string, similarity double")
    return local.groupBy("topic").agg(F.max_by(F.struct("motive", "similarity"), F.struct("similarity")).alias("b")).select("topic", "b.*")


def item_motives(distributions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Summed topic probability per item and category, and the item's leading category."""
    long = distributions.select("appid", F.posexplode("topics").alias("topic", "p")).join(F.broadcast(assigned.select(F.col("topic").cast("int").alias("topic"), "motive")), "topic")
    sums = long.groupBy("appid", "motive").agg(F.sum("p").alias("p"))
    lead = sums.groupBy("appid").agg(F.max_by("motive", F.struct("p", "motive")).alias("lead"))
    return sums.join(lead, "appid")


def category_tags(category: Sequence[float], tag_dims: DataFrame, k: int = 10) -> DataFrame:
    """Tags for a category vector through their correlation with each dimension (columns ``tag``, ``dim``, ``r``)."""
    weights = F.array(*[F.lit(float(x)) for x in category])
    scored = tag_dims.withColumn("_w", weights).groupBy("tag").agg(F.sum(F.col("r") * F.col("_w")[F.col("dim")]).alias("score"))
    return scored.orderBy(F.desc("score"), "tag").limit(k)


def topic_clusters(df: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """Topic per vector by k-means."""
    rows = df.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="topic").fit(rows)
    return model.transform(rows).drop("features")


def topic_words(docs: DataFrame, k: int = 10, words: str = "word") -> DataFrame:
    """Leading words per topic by class-based tf-idf: frequency in the topic times log(1 + mean topic size / word count)."""
    counts = docs.groupBy("topic", words).agg(F.count("*").alias("n"))
    per_topic = counts.groupBy("topic").agg(F.sum("n").alias("t"))
    per_word = counts.groupBy(words).agg(F.sum("n").alias("f"))
    mean = per_topic.agg(F.avg("t").alias("x")).scalar()
    scored = counts.join(per_word, words).join(F.broadcast(per_topic), "topic").withColumn("_a", mean).withColumn(
        "score", F.col("n") / F.col("t") * F.ln(F.col("_a") / F.col("f") + 1.0))
    return top_k_by_group(scored.select("topic", words, "score"), ["topic"], [F.desc("score"), F.asc(words)], k)


def topic_items(distributions: DataFrame, k: int = 10) -> DataFrame:
    long = distributions.select("appid", F.posexplode("topics").alias("topic", "p"))
    return top_k_by_group(long, ["topic"], [F.desc("p"), F.asc("appid")], k)


def tone_scores(votes: DataFrame, tag_scores: DataFrame, distributions: DataFrame, topic_scores: DataFrame, neutral: float = 2.5, tag_share: float = 0.7) -> DataFrame:
    """Tone from a lexicon: vote-weighted tag scores and probability-weighted topic scores, neutral where neither speaks."""
    tag = votes.join(F.broadcast(tag_scores.select("tag", F.col("score").alias("s"))), "tag").groupBy("appid").agg((F.sum(F.col("votes") * F.col("s")) / F.sum("votes")).alias("tag_tone"))
    long = distributions.select("appid", F.posexplode("topics").alias("topic", "p")).join(F.broadcast(topic_scores.select("topic", F.col("score").alias("s"))), "topic")
    topic = long.groupBy("appid").agg(F.when(F.sum("p") > 0.01, F.sum(F.col("p") * F.col("s")) / F.sum("p")).alias("topic_tone"))
    joined = distributions.select("appid").join(tag, "appid", "left").join(topic, "appid", "left")
    mixed = F.coalesce("tag_tone", F.lit(neutral)) * tag_share + F.coalesce("topic_tone", F.lit(neutral)) * (1 - tag_share)
    return joined.select("appid", mixed.alias("tone_score"))


def tag_components(counts: DataFrame, names: Sequence[str], idf: Sequence[float], k: int = 10) -> DataFrame:
    """Leading directions of the tf-idf weighted tag counts: loading of every tag on every direction."""
    weighted = matrix.multiply(counts, "counts", np.diag(np.asarray(idf, dtype=float)), "tfidf")
    _, _, second = matrix.moments(weighted, "tfidf", len(names))
    values, directions = np.linalg.eigh(second)
    top = directions[:, np.argsort(values)[::-1][:k]]
    top *= np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    rows = [(int(c), names[i], float(top[i, c])) for c in range(top.shape[1]) for i in range(len(names))]
    return counts.sparkSession.createDataFrame(rows, "component int, tag string, loading double")


def component_of_tag(loadings: DataFrame, tag: str) -> DataFrame:
    own = loadings.filter(F.col("tag") == tag)
    return own.orderBy(F.desc(F.abs("loading")), "component").limit(1)
