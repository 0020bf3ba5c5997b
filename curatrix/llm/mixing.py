"""Mixing sources to target weights by weighted sampling keys.

Every source has a weight; together they share ``share`` of all words. A source's target is its part by weight, but at most ``most`` times
its own size; what is above goes to the others by weight until none is above. Whole epochs come first: every document is taken
target // size times. The rest is drawn without replacement: documents in order of exponential keys ``-ln(u) / quality`` (u from a
hash of seed and doc_id, so reruns agree), until their words reach the budget; the document at the edge is taken in part.

The order is never made in one task: keys fall in ``BUCKETS`` slots, sums by source and slot (a table of bounded width per source) give the words
before each slot, and only documents in the slot at a source's edge are put in order.

A null text has no words and is taken zero times; a null source is a source of its own, the last; rows without an id draw their key by
their text; equal keys go by doc_id, then by a hash of the text; exact repeats of a row share one place and are
taken alike. Extra columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.storage import stored

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKETS = 1 << 14
SEED = "mix-1"
SMALL = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): capped shares by weight. One row a source.

    In order of size by weight, source k stops at its cap if the words left for it and all after it, by weight, exceed the cap; the
    caps before it are then paid, so one pass over running sums says what repeated resharing would.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), pick)).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ratio = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = (weighed.withColumn("place", F.row_number().over(order)).withColumn("ratio", ratio)
              .withColumn("capped", F.col("cap") <= F.col("ratio") * F.col("weight")))
    settled = ranked.withColumn("first", F.min(F.when(~F.col("capped"), F.col("place"))).over(everything))
    settled = settled.withColumn("level", F.max(F.when(F.col("place") == F.col("first"), F.col("ratio"))).over(everything))
    level = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    value = F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("cap").cast("double")).otherwise(level)
    return settled.select("source", "source_size", F.round(value, 6).alias("target"))


def sampling_key(quality: Column, doc_id: Column, seed: str = SEED, text_key: Column | None = None) -> Column:
    """An exponential of rate ``quality``, the same in every run: small keys come first. Rows without an id draw by ``text_key``."""
    name = F.coalesce(doc_id.cast("string"), F.lit("") if text_key is None else F.concat(F.lit("text "), text_key.cast("string")))
    digits = F.substr(F.md5(F.concat(F.lit(seed + ":"), name)), F.lit(1), F.lit(12))
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / quality


def mixed(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST,
          seed: str = SEED, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, source, key, and ``text_key`` (xxhash64 of the text).

    ``quality`` has (doc_id, quality) with positive weights; documents that it lacks weigh 1, of several values the mean counts.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text).alias("text_key"))
    if quality is not None:
        known = quality.where("doc_id is not null and quality > 0").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        named = rows.where("doc_id is not null").join(known, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(1.0)))
        rows = named.unionByName(rows.where("doc_id is null").withColumn("quality", F.lit(1.0)))  # no join gathers them in one task
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    key = sampling_key(F.col("quality"), F.col("doc_id"), seed, F.col("text_key"))
    rows = rows.withColumn("key", key).withColumn("slot", F.floor(F.col("key") / (F.col("key") + 1) * BUCKETS).cast("int"))
    rows = stored(rows.drop("quality"), "mixing")

    slots = stored(rows.groupBy("source", "slot").agg(F.sum("size").alias("words")), "mixing-slots")
    goals = targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.round("target").cast("long")
    safe = F.greatest("source_size", F.lit(1))
    goals = (goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(whole / safe)).otherwise(0).cast("long"))
             .withColumn("budget", F.when(F.col("source_size") > 0, whole - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long")))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    edges = slots.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    goal = goals.withColumnRenamed("source", "s")
    edge = (edges.join(goal.select("s", "budget"), F.col("source").eqNullSafe(F.col("s"))).where("before < budget and before + words >= budget")
            .select(F.col("s").alias("e"), F.col("slot").alias("edge"), "before"))
    goals = stored(goal.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "mixing-goals")  # one row a source

    few = goals.limit(SMALL + 1).count() <= SMALL  # else a plain join, which may shuffle
    placed = rows.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_edge = (F.col("budget") > 0) & (F.col("slot") == F.col("edge"))
    inside = F.when(F.col("edge").isNotNull() & (F.col("slot") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    rest = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn("part", inside)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_key")
    near = placed.where(at_edge)
    copies = near.groupBy("source", "key", "doc_id", "text_key", "size", "before", "budget").agg(F.count("*").alias("copies"))
    room = F.col("budget") - F.col("before") - (F.sum(F.col("size") * F.col("copies")).over(order) - F.col("size") * F.col("copies"))
    copies = copies.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.floor(room / F.col("copies"))))).select(
        F.col("source").alias("s"), F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "part")
    near = near.join(copies, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
                     & (F.col("text_key") == F.col("t"))).drop("s", "k", "d", "t")
    out = rest.unionByName(near)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "key", "text_key")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``taken`` words (a document may be taken several times, or in part)."""
    takes = mixed(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "taken").distinct()
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(takes, match).drop("__id", "__key")


def label_quality(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: 2 for good documents, 0.5 for bad ones."""
    return labels.where("quality is not null").select("doc_id", F.expr("if(quality = 1, 2.0D, 0.5D)").alias("quality"))


def sql(documents: str = "documents", seed: str = SEED) -> str:
    """The rows of ``mixed`` (without key and text_key) in DuckDB SQL, with one plain running sum."""
    weights = "[" + ", ".join(str(float(w)) for w in WEIGHTS) + "]"
    return f"""WITH known AS (SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, coalesce(q, 1.0) AS q FROM {documents} LEFT JOIN known USING (doc_id)),
k AS (SELECT *, -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / q AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT + 1]::DOUBLE AS w, {MOST} * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () * 1.0 - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
 / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ratio FROM s1 WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
s3 AS (SELECT *, min(place) FILTER (WHERE cap > ratio * w) OVER () AS first FROM s2),
s4 AS (SELECT source, source_size, round(CASE WHEN first IS NULL OR place < first THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * max(ratio) FILTER (WHERE place = first) OVER ()) END, 6) AS target FROM s3),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM s4),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT - epochs * source_size ELSE 0 END AS budget FROM goal),
r AS (SELECT k.*, g.source_size, g.target, g.epochs, g.budget, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
 FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM r"""
