"""Joins that build the item table, a user's views and title matches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.dates import is_placeholder
from curatrix.functions.text import fold_title, numbers_differ, words
from curatrix.session import parallelism


def with_review_counts(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts per item, 0 where none was scraped, and never below the official ones."""
    joined = items.join(counts.select("appid", F.col("positive").alias("_p"), F.col("negative").alias("_n")), "appid", "left")
    return joined.withColumns({
        "positive": F.greatest(F.coalesce(F.col("positive"), F.lit(0)), F.coalesce(F.col("_p"), F.lit(0))),
        "negative": F.greatest(F.coalesce(F.col("negative"), F.lit(0)), F.coalesce(F.col("_n"), F.lit(0)))}).drop("_p", "_n")


def repair_names(df: DataFrame, master: DataFrame) -> DataFrame:
    """Replace unusable names by the master table's."""
    joined = df.join(master.select("appid", F.col("name").alias("_master")), "appid", "left")
    bad = (F.col("name").isNull() | (F.col("name") == "Unknown") | (F.length("name") > 50)
           | F.col("name").contains("<") | F.col("name").contains(":"))
    return joined.withColumn("name", F.when(bad, F.coalesce("_master", "name")).otherwise(F.col("name"))).drop("_master")


def library_items(library: DataFrame, items: DataFrame) -> DataFrame:
    """A library joined to its items; the item's own name keeps the suffix ``_global``."""
    return library.join(items.withColumnRenamed("name", "name_global"), "appid")


def manual_additions(truth: DataFrame, library: DataFrame, items: DataFrame) -> DataFrame:
    """Rated items that are not in the library, with their names."""
    keys = [c for c in ("user_id", "appid") if c in truth.columns]
    return truth.join(library.select(*keys), keys, "left_anti").join(items.select("appid", "name"), "appid")


def _status(default: Column) -> Column:
    return F.coalesce(F.col("status"), F.when(F.col("ignore"), F.lit("ignored")).otherwise(default))


def _own_rows(labels: DataFrame, truth: DataFrame, default: Column) -> DataFrame:
    joined = labels.join(truth.select("user_id", "appid", "actual_rating", "ignore", "status"), ["user_id", "appid"], "left")
    return joined.withColumns({"actual_rating": F.coalesce("actual_rating", F.col("predicted_rating").cast("double")),
                               "ignore": F.coalesce("ignore", F.lit(False))}).withColumns(
        {"status": _status(default), "is_manual": F.lit(False)})


def _manual_rows(labels: DataFrame, truth: DataFrame, items: DataFrame) -> DataFrame:
    extra = manual_additions(truth, labels, items)
    return extra.select("user_id", "appid", "name", F.lit(0.0).alias("playtime"), F.lit(5).alias("predicted_rating"), "actual_rating",
                        F.coalesce("ignore", F.lit(False)).alias("ignore"), F.col("status"), F.lit(True).alias("is_manual")).withColumn(
        "status", _status(F.lit("rated")))


VIEW_COLUMNS = ("user_id", "appid", "name", "playtime", "predicted_rating", "actual_rating", "ignore", "status", "is_manual")


def verify_view(labels: DataFrame, truth: DataFrame, items: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Played and released items of each library plus manual ones, ratings defaulted, ignored ones left out."""
    released = items.select("appid", "parsed_date", "release_date")
    visible = labels.filter(F.col("playtime") > 0).join(released, "appid").filter(
        (F.col("parsed_date") <= F.lit(as_of)) & ~is_placeholder(F.col("release_date")))
    own = _own_rows(visible, truth, F.lit("played")).select(*VIEW_COLUMNS)
    both = own.unionByName(_manual_rows(labels, truth, items).select(*VIEW_COLUMNS))
    return both.filter(F.col("status") != "ignored")


def catalogue_view(labels: DataFrame, truth: DataFrame, items: DataFrame) -> DataFrame:
    """Everything owned or added by hand; the default status follows the playtime."""
    default = F.when(F.col("playtime") > 0, F.lit("played")).otherwise(F.lit("backlog"))
    own = _own_rows(labels, truth, default).select(*VIEW_COLUMNS)
    return own.unionByName(_manual_rows(labels, truth, items).select(*VIEW_COLUMNS))


def merge_external_library(truth: DataFrame, external: DataFrame, items: DataFrame) -> DataFrame:
    """Add an external list: only known items the user does not have yet, as backlog with rating 5."""
    fresh = (external.select("user_id", "appid").distinct()
             .join(truth.select("user_id", "appid"), ["user_id", "appid"], "left_anti").join(items.select("appid"), "appid", "left_semi"))
    added = fresh.select("user_id", "appid", F.lit(5.0).alias("actual_rating"), F.lit(False).alias("ignore"), F.lit("backlog").alias("status"))
    return truth.unionByName(added, allowMissingColumns=True)


def missing_from_system(external: DataFrame, *known: DataFrame) -> DataFrame:
    """External rows whose id no known table has, longest played first."""
    ids = None
    for df in known:
        ids = df.select("appid") if ids is None else ids.union(df.select("appid"))
    return external.join(ids.distinct(), "appid", "left_anti").orderBy(F.desc("playtime"), "appid")


def status_changes(before: DataFrame, after: DataFrame, status: str = "played") -> DataFrame:
    """Rows that reached a status between two snapshots: changed to it, or new with it."""
    keys = ["user_id", "appid"]
    old = before.select(*keys, F.col("status").alias("old_status"))
    joined = after.filter(F.col("status") == status).join(old, keys, "left")
    return joined.filter(F.col("old_status").isNull() | (F.col("old_status") != status)).select(
        *keys, "old_status", F.when(F.col("old_status").isNull(), F.lit("new")).otherwise(F.lit("changed")).alias("change"))


def match_titles(external: DataFrame, items: DataFrame) -> DataFrame:
    """External titles to item ids over the folded title. Of equal titles the last item wins; an item is used once."""
    by_title = (items.withColumn("key", fold_title(F.col("name"))).filter(F.col("key") != "")
                .groupBy("key").agg(F.max("appid").alias("appid")))
    found = external.withColumn("key", fold_title(F.col("title"))).join(by_title, "key")
    return found.groupBy("appid").agg(F.min("title").alias("title"))


def _distinct_titles(df: DataFrame, key: str, title: str) -> DataFrame:
    """Distinct folded titles, each with its smallest id: copies of one title never meet each other."""
    folded = df.select(key, fold_title(F.col(title)).alias("folded")).filter(F.col("folded") != "")
    return folded.groupBy("folded").agg(F.min(key).alias(key))


def _asked_places(df: DataFrame, key: str) -> DataFrame:
    """(key, word, beside): every place of an index under which a container of the text must stand; texts of two words or more."""
    words = F.col("words")
    n = F.size(words)
    inner = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.get(words, i).alias("word"), F.concat(
        F.lit("<"), F.when(i > 1, F.get(words, i - 1)).otherwise(F.substring(F.get(words, F.lit(0)), -1, 1))).alias("beside")))
    ending = F.array(F.struct(F.get(words, n - 2).alias("word"), F.concat(F.lit(">"), F.get(words, n - 1)).alias("beside")))
    two = F.array(F.struct(F.get(words, F.lit(0)).alias("word"), F.concat(F.lit("~"), F.substring(F.get(words, F.lit(1)), 1, 3)).alias("beside")))
    return df.filter(n > 1).select(key, F.inline(F.when(n > 2, F.concat(inner, ending)).otherwise(two)))


def _held_places(df: DataFrame, key: str) -> DataFrame:
    """(key, word, beside): the index of all places of a text, each word with its neighbours or the parts of them that a contained text may end in."""
    words = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(F.get("words", i).alias("w"), F.when(i > 0, F.get("words", i - 1)).alias("p"), F.get("words", i + 1).alias("q")))
    rows = df.select(key, F.inline(words))
    before = rows.filter("p IS NOT NULL").select(key, F.col("w").alias("word"), F.explode(F.array(F.concat(F.lit("<"), "p"), F.concat(F.lit("<"), F.substring("p", -1, 1)))).alias("beside"))
    nexts = rows.filter("q IS NOT NULL")
    after = nexts.select(key, F.col("w").alias("word"), F.explode(F.transform(F.sequence(F.lit(1), F.length("q")), lambda i: F.concat(F.lit(">"), F.substring("q", F.lit(1), i)))).alias("beside"))
    tails = nexts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", i, F.length("w")))).alias("word"), "q")
    short = tails.select(key, "word", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("q"))), lambda i: F.concat(F.lit("~"), F.substring("q", F.lit(1), i)))).alias("beside"))
    return before.unionByName(after).unionByName(short).distinct()


def _containers(asked: DataFrame, ask: str, held: DataFrame, hold: str) -> DataFrame:
    """(ask, hold) pairs where the held text contains the asked one, each asked text looked up at its rarest place."""
    index = _held_places(held, hold)
    counts = index.groupBy("word", "beside").agg(F.count("*").alias("df"))
    places = _asked_places(asked, ask).join(counts, ["word", "beside"], "left")
    rarest = places.groupBy(ask).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "beside")).alias("r"))
    met = rarest.filter("r.df > 0").select(ask, "r.word", "r.beside").join(index, ["word", "beside"]).select(ask, hold)
    texts = met.join(asked.select(ask, F.col("folded").alias("inner_text")), ask).join(held.select(hold, F.col("folded").alias("outer_text")), hold)
    return texts.filter(F.col("outer_text").contains(F.col("inner_text")))


def contained_titles(external: DataFrame, items: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """Titles where one contains the other: length ratio above the bound, same numbers, not one plain word.

    Every word of a contained text but its first and last is a whole word of the container and has its neighbours there. Texts are looked up in an
    index of (word, what stands beside it) by their rarest place in it, so a word or a pair of words that all titles share is no key
    while the text has anything rarer. A text with a place that the index lacks meets nothing.
    """
    left, right = (df.withColumn("words", F.split("folded", " ")) for df in (_distinct_titles(external, "ext_id", "title"), _distinct_titles(items, "appid", "name")))
    a = _containers(left, "ext_id", right, "appid").select("ext_id", "appid", F.col("inner_text").alias("l_text"), F.col("outer_text").alias("r_text"))
    b = _containers(right, "appid", left, "ext_id").select("ext_id", "appid", F.col("outer_text").alias("l_text"), F.col("inner_text").alias("r_text"))
    pairs = a.union(b).distinct().withColumns({"l_n": F.length("l_text"), "r_n": F.length("r_text")})
    ratio = F.least("l_n", "r_n") / F.greatest("l_n", "r_n")
    kept = pairs.withColumn("ratio", ratio).filter((F.col("ratio") > min_ratio) & ~numbers_differ(F.col("l_text"), F.col("r_text")))
    best = kept.groupBy("ext_id").agg(F.max_by(F.struct("appid", "ratio"), F.struct("ratio", -F.col("appid"))).alias("b"))
    return best.select("ext_id", F.col("b.appid").alias("appid"), (F.col("b.ratio") * 0.9).alias("confidence"))


def closest_titles(external: DataFrame, items: DataFrame, min_similarity: float = 0.9) -> DataFrame:
    """Closest title by edit distance with similarity 1 - distance / longer length.

    Blocks are exact for the bound: with at most d edits one of d + 1 even pieces of the shorter-keyed
    text survives, and lengths differ by at most d. Titles are distinct before they meet.
    """
    left, right = _distinct_titles(external, "ext_id", "title"), _distinct_titles(items, "appid", "name")
    slack = 1.0 - min_similarity

    def edits(n: Column) -> Column:
        return F.floor(n * F.lit(slack / min_similarity) + F.lit(1e-9)).cast("int")

    def cut(text: Column, n: Column, parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(
            F.floor(i * n / parts).cast("int").alias("at"),
            F.substring(text, F.floor(i * n / parts).cast("int") + 1,
                        (F.floor((i + 1) * n / parts) - F.floor(i * n / parts)).cast("int")).alias("piece")))

    l = left.withColumns({"l_text": F.col("folded"), "l_n": F.length("folded")}).drop("folded")
    l = l.withColumn("d", edits(F.col("l_n")))
    l_blocks = l.select("ext_id", "l_text", "l_n", "d", F.inline(cut(F.col("l_text"), F.col("l_n"), F.least(F.col("d") + 1, F.col("l_n")))))
    probes = l_blocks.select("ext_id", "l_text", "l_n", "piece", "d",
                             F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.col("at") + F.col("d"))).alias("pos"),
                             F.length("piece").alias("piece_n"))
    r = right.withColumns({"r_text": F.col("folded"), "r_n": F.length("folded")}).drop("folded")
    lengths = l_blocks.select(F.length("piece").alias("piece_n")).distinct().agg(F.sort_array(F.collect_set("piece_n")).alias("x")).scalar()
    r_blocks = r.withColumn("piece_n", F.explode(lengths)).filter(F.col("piece_n") <= F.col("r_n")).select(
        "appid", "r_text", "r_n", "piece_n", F.explode(F.sequence(F.lit(0), F.col("r_n") - F.col("piece_n"))).alias("pos")).withColumn(
        "piece", F.substring(F.col("r_text"), F.col("pos") + 1, F.col("piece_n")))
    pairs = (probes.join(r_blocks, ["piece", "piece_n", "pos"]).filter(F.abs(F.col("l_n") - F.col("r_n")) <= F.col("d"))
             .select("ext_id", "appid", "l_text", "r_text", "l_n", "r_n").distinct())
    similarity = F.lit(1.0) - F.levenshtein("l_text", "r_text") / F.greatest("l_n", "r_n")
    kept = pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= F.lit(min_similarity - 1e-12))
    best = kept.groupBy("ext_id").agg(F.max_by(F.struct("appid", "similarity"), F.struct("similarity", -F.col("appid"))).alias("b"))
    return best.select("ext_id", "b.appid", "b.similarity")


SURE_WORDS = 6


def _title_words(titles: DataFrame) -> DataFrame:
    return titles.select("appid", F.array_sort(F.array_distinct(words(F.col("name")))).alias("w"))


def title_sets(titles: DataFrame, min_shared: int = 2) -> DataFrame:
    """(appid, set_id): the word set of every title, named as in ``series_twins``; titles with few words are sets of their own."""
    own = _title_words(titles)
    sets = own.filter(F.size("w") >= min_shared).groupBy("w").agg(F.min("appid").alias("set_id"))
    return own.join(sets, "w", "left").select("appid", F.coalesce("set_id", "appid").alias("set_id"))


def series_twins(titles: DataFrame, min_shared: int = 2, min_share: float = 0.7) -> DataFrame:
    """Pairs of titles of one series: enough shared words, and more than a share of the longer title's words.

    Word sets are compared once per distinct set; titles with equal sets are linked through that set, so
    copies do not multiply. Two sets need ``max(min_shared, floor(min_share * len) + 1)`` words in common, len being the longer one's. In one order of
    all words, rarest first, two sets of len_a and len_b words that have ``need`` in common share ``sure`` of them (``SURE_WORDS``, ``need`` at most) among the first
    len_a - need + sure of the one and len_b - need + sure of the other. Pairs are counted there, and only those that
    share so many meet with all their words.
    """
    sets = _title_words(titles).filter(F.size("w") >= min_shared).groupBy("w").agg(F.min("appid").alias("set_id"))
    tokens = sets.select("set_id", F.explode("w").alias("word"))
    counts = tokens.groupBy("word").agg(F.count("*").alias("df"))
    order = W.partitionBy("set_id").orderBy("df", "word")
    ranked = tokens.join(counts, "word").withColumns({"r": F.row_number().over(order), "len": F.count("*").over(W.partitionBy("set_id"))})
    ranked = ranked.withColumn("need", F.greatest(F.lit(min_shared), F.floor(F.lit(min_share) * F.col("len")).cast("int") + 1))
    probe = ranked.filter(F.col("r") <= F.col("len") - F.col("need") + F.least(F.lit(SURE_WORDS), F.col("need"))).select("set_id", "word", "r", "len", "need")
    need = F.greatest("a.need", "b.need")
    sure = F.least(F.lit(SURE_WORDS), need)
    met = probe.alias("a").join(probe.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.set_id") < F.col("b.set_id")) & (F.least("a.len", "b.len") >= need)
                                & (F.least(F.col("a.len") - F.col("a.r"), F.col("b.len") - F.col("b.r")) + sure >= need))
    counted = met.groupBy(F.col("a.set_id").alias("left_id"), F.col("b.set_id").alias("right_id")).agg(F.count("*").alias("n"), F.first(sure).alias("sure"))
    pairs = counted.filter(F.col("n") >= F.col("sure")).select("left_id", "right_id")
    lw, rw = sets.select(F.col("set_id").alias("left_id"), F.col("w").alias("lw")), sets.select(F.col("set_id").alias("right_id"), F.col("w").alias("rw"))
    full = pairs.join(lw, "left_id").join(rw, "right_id").withColumn("shared", F.size(F.array_intersect("lw", "rw")))
    share = F.col("shared") / F.greatest(F.size("lw"), F.size("rw"))
    return full.filter((F.col("shared") >= min_shared) & (share > min_share)).select("left_id", "right_id", "shared")


def as_of_range(df: DataFrame, x: str, curve: DataFrame, pieces: int | None = None) -> DataFrame:
    """For every distinct ``x``: the curve's last point at or below it (``low``) and its first at or above (``high``), as structs (cx, cy).

    Curve points and distinct values are cut into the same ranges by a quantile sketch and read in order within each range; the nearest
    points of the ranges below and above come from one small table with a row for each range, so ranges need not hold points.
    """
    pieces = pieces or max(64, parallelism(df))
    point = F.struct("cx", "cy")
    points = curve.filter(F.col("cx").isNotNull()).groupBy(F.col("cx").cast("double").alias("cx")).agg(F.avg("cy").alias("cy")).select(F.col("cx").alias("_x"), point.alias("_p"), F.lit(False).alias("_asked"))
    asked = df.select(F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull()).distinct().select("_x", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_asked"))
    both = points.unionByName(asked)
    cuts = both.agg(F.percentile_approx("_x", [i / pieces for i in range(1, pieces)], 1000).alias("b")).first()["b"] or []
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    placed = both.withColumn("_piece", F.size(F.filter(edges, lambda e: e < F.col("_x"))))
    ends = placed.groupBy("_piece").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_x"))).alias("_last"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("_x"))).alias("_first"))
    order = W.partitionBy(F.lit(0)).orderBy("_piece")  # at most ``pieces`` rows
    shifts = ends.select(F.col("_piece").alias("_at"), F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_below"),
                         F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_above"))
    inside = W.partitionBy("_piece").orderBy("_x")
    near = placed.withColumns({"low": F.last("_p", True).over(inside.rangeBetween(W.unboundedPreceding, 0)), "high": F.first("_p", True).over(inside.rangeBetween(0, W.unboundedFollowing))})
    joined = near.filter("_asked").join(shifts, F.col("_piece") == F.col("_at"))
    return joined.select(F.col("_x").alias(x), F.coalesce("low", "_below").alias("low"), F.coalesce("high", "_above").alias("high"))


def interpolate(df: DataFrame, x: str, curve: DataFrame, target: str, pieces: int | None = None) -> DataFrame:
    """Linear interpolation of ``x`` on a curve (columns ``cx``, ``cy``), flat beyond its ends; null for a null ``x`` or an empty curve.

    Equal values of ``x`` are looked up once (``as_of_range``), and the rows join their value.
    """
    near = as_of_range(df, x, curve, pieces)
    low, high = F.col("low"), F.col("high")
    step = low["cy"] + (high["cy"] - low["cy"]) * (F.col(x) - low["cx"]) / F.when(high["cx"] > low["cx"], high["cx"] - low["cx"]).otherwise(F.lit(1.0))
    values = near.select(F.col(x).alias("_value"), F.coalesce(step, low["cy"], high["cy"]).alias(target))
    return df.join(values, F.col(x).cast("double") == F.col("_value"), "left").drop("_value")
