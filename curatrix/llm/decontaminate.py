"""Benchmark passages in documents, verbatim or with other numbers, names and units.

Every text becomes a sequence of template tokens: lower-cased words without outer punctuation, where numbers, names (a capital
followed by a small letter) and units are typed placeholders. Windows of eight tokens of the items meet windows of the documents by a hash join;
documents first pass a fixed-size bitmap of the items' windows, so only few windows travel. Windows in one alignment (document
position less item position) vote for it if their slots are consistent: equal values of the item stand for equal values of the document (two
values of the item may have become one). Where a value of the item met several, the one that most windows hold counts, and windows that
hold another do not vote. A document leaks an item if the windows that vote cover ``coverage`` of the item's windows; the leak is exact if
every slot of the alignment kept its value.

Items shorter than a window are one window of their own length; windows with fewer than two plain words say nothing, unless an item has no others; an item of
fewer than ``SHORTEST`` tokens, which any prose may hold, leaks into documents that are nothing but its words. Of two document values that
equally many windows give a value of the item, the unchanged one holds, else the greater hash. Null or blank texts and
items match nothing; repeated documents are judged each, repeated items all are named; extra columns are ignored; with an empty
benchmark no document leaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.storage import stored
from curatrix.llm.words import blocks, hashes_of, mix, word_bounds

WINDOW = 8
SHORTEST = 4
BITS = 1 << 22
# fixed values: units of measure that stand for each other in a template
UNITS = ("mm cm dm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton "
         "tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months "
         "year years cent cents dollar dollars euro euros percent degree degrees").split()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INNER = _DIGIT.copy()
_INNER[[36, 37, 43, 44, 45, 46, 47, 58]] = True  # $ % + , - . / :
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (11, 12, 13))


def _word_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return hashes_of(data, starts, ends)


_UNIT_HASHES = np.sort(_word_hash(UNITS))


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words less the punctuation around them (and which of them have anything left)."""
    plain = np.flatnonzero(_PLAIN[data])
    padded = np.append(plain, len(data) + 1)
    first = padded[np.searchsorted(plain, starts)]
    back = np.searchsorted(plain, ends) - 1
    last = np.where(back >= 0, padded[back], -1) + 1
    kept = (first < ends) & (last > starts)
    return first[kept], last[kept], kept


def templates(data: np.ndarray, offsets: np.ndarray):
    """Template token hashes, plain word hashes, which tokens are slots, and the tokens before each row of a block."""
    starts, ends, rows = word_bounds(data, offsets)
    starts, ends, kept = _trimmed(data, starts, ends)
    rows = np.concatenate(([0], np.cumsum(kept)))[rows]
    words = hashes_of(data, starts, ends)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    inner = np.concatenate(([0], np.cumsum(_INNER[data])))
    number = (inner[ends] - inner[starts] == ends - starts) & (digits[ends] > digits[starts])
    a = data[starts] if len(starts) else np.zeros(0, np.uint8)
    b = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else a
    c = data[np.minimum(starts + 2, len(data) - 1)] if len(starts) else a
    small = ((b >= 97) & (b <= 122) | (b >= 128)) & (ends - starts > 1)
    accent = (a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (ends - starts > 2) & ((c >= 97) & (c <= 122) | (c >= 128))
    name = (a >= 65) & (a <= 90) & small | accent
    unit = np.isin(words, _UNIT_HASHES)
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words)))
    return token, words, number | unit | name, rows


def windows(token: np.ndarray, slot: np.ndarray, rows: np.ndarray, size: int, least: int = 2):
    """(row, position in the row, hash) of the windows of ``size`` tokens with at least ``least`` plain words."""
    n = np.diff(rows)
    counts = np.maximum(0, n - size + 1)
    owner = np.repeat(np.arange(len(n)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + rows[:-1][owner]
    plain = np.concatenate(([0], np.cumsum(~slot)))
    good = plain[at + size] - plain[at] >= least
    owner, place, at = owner[good], place[good], at[good]
    total = np.full(len(at), size, np.uint64)
    for j in range(size):
        total = mix(total ^ token[at + j])
    return owner, place, at, total


def _hits(sizes: list[int], least: int, bitmap=None):
    """Windows of each row, with their slot values; all of them, or those in ``bitmap``."""

    def run(batches):
        for batch in batches:
            for start, _, data, offsets in blocks(batch.column("text")):
                token, words, slot, rows = templates(data, offsets)
                for size in sizes:
                    owner, place, at, total = windows(token, slot, rows, size, least)
                    if bitmap is not None:
                        low = (total % np.uint64(BITS)).astype(np.int64)
                        got = np.unpackbits(bitmap.value[low >> 3][:, None], axis=1)[np.arange(len(low)), low & 7].astype(bool) if len(low) else np.zeros(0, bool)
                        owner, place, at, total = owner[got], place[got], at[got], total[got]
                    if not len(at):
                        continue
                    # a window's slot values, and 0 for its plain words
                    values = np.where(slot, words, np.uint64(0))[at[:, None] + np.arange(size)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(at) + 1, size, dtype=np.int32)), pa.array(values.ravel()))
                    ids = batch.column("id").take(pa.array(start + owner))
                    keys = batch.column("key").take(pa.array(start + owner))
                    yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.full(len(at), size)), pa.array(place), pa.array(total.view(np.int64)), lists],
                                                     names=["id", "key", "size", "place", "hash", "slots"])

    return run


_SHAPE = "id long, key long, size long, place long, hash long, slots array<long>"


def _lengths(batches):
    for batch in batches:
        for at, to, data, offsets in blocks(batch.column("text")):
            _, _, _, rows = templates(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("key").slice(at, to - at), batch.column("text").slice(at, to - at),
                                              pa.array(np.diff(rows))], names=["id", "key", "text", "n"])


def _keyed(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def item_windows(items: DataFrame, name: str, text: str) -> DataFrame:
    """All windows of the items and each item's number of windows."""
    sized = stored(_keyed(items, name, text).where("id is not null").mapInArrow(_lengths, "id long, key long, text string, n long").where(f"n >= {SHORTEST}"), "items")
    parts = sized.where(f"n >= {WINDOW}").mapInArrow(_hits([WINDOW], 2), _SHAPE)
    bare = sized.join(parts.select("id", "key").distinct(), ["id", "key"], "left_anti")  # short, or all slots
    for size in range(SHORTEST, WINDOW + 1):
        some = bare.where(f"n >= {WINDOW}" if size == WINDOW else f"n = {size}")
        parts = parts.unionByName(some.mapInArrow(_hits([size], 0), _SHAPE))
    parts = stored(parts.distinct(), "item-windows")
    total = parts.groupBy("id", "key").agg(F.count("*").alias("windows"))
    return parts.join(total, ["id", "key"])


def _sequences(batches):
    """The word sequences of the texts of fewer than SHORTEST tokens, but at least one, as (length, hash)."""
    for batch in batches:
        for start, _, data, offsets in blocks(batch.column("text")):
            _, words, _, rows = templates(data, offsets)
            n = np.diff(rows)
            some = np.flatnonzero((n > 0) & (n < SHORTEST))
            total = n[some].astype(np.uint64)
            for j in range(SHORTEST - 1):
                inside = n[some] > j
                total[inside] = mix(total[inside] ^ words[rows[some[inside]] + j])
            own = pa.array(start + some)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("key").take(own), pa.array(total.view(np.int64))], names=["id", "key", "hash"])


def _whole(wide: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of the shortest items: documents with the same few words and no others."""
    asked = stored(items.where("id is not null").mapInArrow(_sequences, "id long, key long, hash long").select(F.col("id").alias("item_id"), "hash").distinct(), "short-items")
    if not asked.limit(1).count():  # the texts need no pass of their own
        return wide.where("false").selectExpr("id", "key", "id item_id", "1D covered", "true exact")
    held = wide.mapInArrow(_sequences, "id long, key long, hash long").distinct()
    return held.join(asked, "hash").select("id", "key", "item_id", F.lit(1.0).alias("covered"), F.lit(True).alias("exact"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", coverage: float = 0.5) -> DataFrame:
    """(id, key, item_id, covered, exact) of the documents' leaks; key is xxhash64 of the text."""
    spark = docs.sparkSession
    known = stored(item_windows(items, "item_id", "text"), "known")
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # 8 at most
    low = known.select(F.pmod(F.expr("hash"), F.lit(BITS)).alias("low")).distinct().toPandas()["low"].to_numpy()  # BITS at most
    bits = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(bits, low.astype(np.int64) >> 3, (128 >> (low.astype(np.int64) & 7)).astype(np.uint8))
    bitmap = spark.sparkContext.broadcast(bits)
    wide = _keyed(docs, "doc_id", text)
    whole = _whole(wide, _keyed(items, "item_id", "text"))
    if not sizes:
        return whole
    hits = wide.mapInArrow(_hits(sizes, 2 if sizes == [WINDOW] else 0, bitmap), _SHAPE).distinct()
    item = known.select("hash", "size", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "windows")
    changes = F.array_distinct(F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda z: z["a"] != 0))
    met = hits.join(item, ["hash", "size"]).select("id", "key", "item_id", "item_key", "windows", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", changes.alias("pairs"))
    met = stored(met, "alignments")

    line = ["id", "key", "item_id", "item_key", "shift"]
    pairs = met.select(*line, "item_place", F.explode("pairs").alias("p")).select(*line, "item_place", "p.a", "p.b")
    counts = pairs.groupBy(*line, "a", "b").agg(F.count("*").alias("n"))
    order = F.struct("n", (F.col("a") == F.col("b")).alias("same"), "b")
    holds = counts.groupBy(*line, "a").agg(F.max_by("b", order).alias("held"), F.count("*").alias("several"), F.bool_and(F.col("a") == F.col("b")).alias("kept"))
    # null ids of documents must meet themselves in these joins
    def on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
        named = right.select(*[F.col(c).alias(f"r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
        return left.join(named, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys], how).drop(*[f"r_{c}" for c in keys])

    split = on(pairs, holds.where("several > 1").select(*line, "a", "held"), [*line, "a"], "inner")
    lost = split.where("b <> held").select(*line, "item_place").distinct()
    votes = on(met.drop("pairs"), lost, [*line, "item_place"], "left_anti")
    kept = holds.groupBy(*line).agg(F.every("kept").alias("kept"))
    votes = on(votes, kept, line, "left")
    found = votes.groupBy("id", "key", "item_id", "item_key").agg((F.count_distinct("item_place") / F.first("windows")).alias("covered"), F.every(F.coalesce("kept", F.lit(True))).alias("exact"))
    found = found.where(F.col("covered") >= coverage).select("id", "key", "item_id", "covered", "exact").unionByName(whole)
    return found.groupBy("id", "key", "item_id").agg(F.max("covered").alias("covered"), F.max("exact").alias("exact"))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", coverage: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, leaked, n_items, item_ids (ascending), n_exact, covered (largest share of an item)."""
    found = matches(docs, items, text, coverage).groupBy("id", "key").agg(
        F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.max("covered").alias("covered"))
    rows = docs.select(F.col("doc_id"), F.col("doc_id").cast("long").alias("a"), F.xxhash64(text).alias("b"))
    out = rows.join(found, F.col("a").eqNullSafe(F.col("id")) & (F.col("b") == F.col("key")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
                      F.coalesce("covered", F.lit(0.0)).alias("covered"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    found = matches(docs, items, text, coverage).select(F.col("id").alias("__leak_id"), F.col("key").alias("__leak_key")).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_id")) & (F.xxhash64(F.col(text)) == F.col("__leak_key"))
    return docs.join(found, match, "left_anti")
