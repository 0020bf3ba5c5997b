"""Ranked lexical search by pipelined term partitioning.

Documents are cut into shards of at most ``SHARD`` documents. One pass over the texts writes the postings of every shard: for each term that an item
may use, the places in the shard and the counts. Terms belong to owners by document frequency, rare ones first (``OWNERS``). Items travel in bundles
of about ``BUNDLE``; a bundle carries one sparse accumulator a shard (item, place, integer score) through the owners in turn. A stage cogroups
accumulators and the owner's postings of (bundle, shard), adds ``weight * gain`` and writes the accumulators again.

Scores only grow, and a term adds at most its weight times its largest gain. So after each stage an accumulator goes if it could not reach the item's tenth
best score with all that the later owners can still add; the tenth best so far, of the shard and of all shards, bounds the final one from below, and equal
scores stay. The result is the same as without this.

The weight of a term is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, its gain ``(10^9 tf) div (1000 tf + 8 m)`` with
``m = 25 + (75 n N) div L``; an item's score of a document sums both over the item's terms with their repeats. Terms are compared by 64-bit hashes.

Null and empty texts have no terms and are not counted. A null doc_id sorts last among equal scores; rows that repeat a doc_id are documents of their
own. Exact repeats of an item are one; rows of one item_id with other texts are one item with all their terms; a null item_id is an item. Items
without terms, or whose terms no document holds, return nothing, as do empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.bitmap import bitmap, contains
from curatrix.llm.storage import stored
from curatrix.llm.words import BLOCK, blocks, hashes_of, word_bounds

BITS = 1 << 23
SHARD, HELD = 8192, 1 << 20
BUNDLE = 64
OWNERS = (1 / 512, 1 / 64, 1 / 16, 1.0)
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_bounds(data, offsets, _GAP)
    return hashes_of(data, starts, ends), rows


def _item_terms(batches):
    for batch in batches:
        for at, _, data, offsets in blocks(batch.column("text"), 4 * BLOCK):
            hashes, rows = _terms(data, offsets)
            owner = pa.array(at + np.searchsorted(rows, np.arange(len(hashes)), side="right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(owner), pa.array(hashes.view(np.int64))], names=["item_id", "term"])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal sorted keys (len + 1)."""
    return np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))), [len(keys)]))


class _Shard:
    """Postings of one shard as they gather in a task."""

    def __init__(self, number: int):
        self.number, self.ids, self.sizes, self.parts, self.held, self.documents = number, [], [], [], 0, 0

    def add(self, ids: pa.Array, sizes: np.ndarray, term: np.ndarray, place: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.parts.append((term, self.documents + place, times))
        self.held += len(term)
        self.documents += len(sizes)

    def rows(self) -> pa.RecordBatch:
        """A row without a term for the documents (ids in ``ids``, sizes in ``n``), then one for each term."""
        term, place, times = (np.concatenate([p[j] for p in self.parts]) for j in range(3))
        sizes = np.concatenate(self.sizes)
        order = np.lexsort((place, term))
        term, place, times = term[order], place[order], times[order]
        cut = _runs(term)
        several = len(cut) - 1
        one = pa.array([0, len(sizes)], pa.int32())
        none = pa.array(np.zeros(several + 1, np.int32))

        def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
            bounds = np.concatenate(([0], [len(first)], len(first) + cut[1:])).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate((first, values)).astype(np.int32)))

        ids = pa.concat_arrays([pa.ListArray.from_arrays(one, pa.concat_arrays(self.ids)), pa.ListArray.from_arrays(none, pa.array([], pa.int64()))])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(several + 1, self.number)), pa.array(np.append(0, term[cut[:-1]].view(np.int64)), mask=np.arange(several + 1) == 0), ids,
             lists(place, np.zeros(0)), lists(times, np.zeros(0)), lists(sizes[place], sizes)], names=["shard", "term", "ids", "place", "times", "n"])


def _postings(known, most: int, held: int):
    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        shard = _Shard(base)
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column("text")):
                hashes, rows = _terms(data, offsets)
                hit = np.flatnonzero(contains(known.value, hashes))
                place = np.searchsorted(rows, hit, side="right") - 1
                order = np.lexsort((hashes[hit], place))
                term, place = hashes[hit][order], place[order]
                fresh = np.ones(len(term), bool)
                fresh[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
                first = np.flatnonzero(fresh)
                shard.add(batch.column("doc_id").slice(at, to - at), np.diff(rows), term[first], place[first], np.diff(np.append(first, len(term))))
                if shard.held >= held or shard.documents >= most:
                    yield shard.rows()
                    count += 1
                    shard = _Shard(base + count)
        if shard.sizes:
            yield shard.rows()

    return run


_POSTING = "shard long, term long, ids array<long>, place array<int>, times array<int>, n array<int>"


def _gains(times: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 25 + (75 * n.astype(np.int64) * documents) // max(1, words)
    return (1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 8 * m)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the bounds of its rows (len + 1)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _best_gain(documents: int, words: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                times, bounds = _flat(batch.column("times"))
                gains = _gains(times, _flat(batch.column("n"))[0], documents, words)
                yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.maximum.reduceat(gains, bounds[:-1]))], names=["term", "df", "gain"])

    return run


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1


_CARRIED = "bundle long, shard long, slot array<int>, place array<int>, score array<long>, top_slot array<int>, top_score array<long>"


def _stage(k: int, documents: int, words: int):
    """Accumulators of one (bundle, shard) after an owner's postings: all that can still be among the best ``k``."""

    def run(carried: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, shard = (carried if len(carried) else postings)["bundle"][0].as_py(), (carried if len(carried) else postings)["shard"][0].as_py()
        floor = np.array((carried if len(carried) else postings)["floor"][0].as_py(), np.int64)
        rest = np.array((carried if len(carried) else postings)["rest"][0].as_py(), np.int64)
        slots, wide = len(floor), 1
        place = _flat(carried["place"])[0] if len(carried) else np.zeros(0, np.int32)
        wide = max(wide, int(place.max(initial=-1)) + 1)
        lists = None
        if len(postings):
            places, bounds = _flat(postings["place"])
            lists = places, bounds, _gains(_flat(postings["times"])[0], _flat(postings["n"])[0], documents, words), *_flat(postings["slots"]), _flat(postings["weights"])[0]
            wide = max(wide, int(places.max(initial=-1)) + 1)
        sums = np.zeros((slots, wide), np.int64)
        if len(carried):
            sums[_flat(carried["slot"])[0], place] = _flat(carried["score"])[0]
        if lists:
            places, bounds, gains, who, who_bounds, weights = lists
            for t in range(len(bounds) - 1):
                at, gain = places[bounds[t]:bounds[t + 1]], gains[bounds[t]:bounds[t + 1]]
                for j in range(who_bounds[t], who_bounds[t + 1]):
                    sums[who[j], at] += weights[j] * gain
        slot_out, place_out, score_out, top_slot, top_score = [], [], [], [], []
        for s in range(slots):
            at = np.flatnonzero(sums[s])
            if not len(at):
                continue
            scores = sums[s, at]
            least = max(int(floor[s]), _kth(scores, k))
            stay = scores + rest[s] >= least
            at, scores = at[stay], scores[stay]
            slot_out.append(np.full(len(at), s))
            place_out.append(at)
            score_out.append(scores)
            best = np.sort(scores)[::-1][:k]
            top_slot.append(np.full(len(best), s))
            top_score.append(best)

        def joined(parts: list[np.ndarray], kind: str) -> pa.Array:
            values = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))

        return pa.Table.from_arrays(
            [pa.array([bundle]), pa.array([shard]), joined(slot_out, "int32"), joined(place_out, "int32"), joined(score_out, "int64"), joined(top_slot, "int32"), joined(top_score, "int64")],
            names=["bundle", "shard", "slot", "place", "score", "top_slot", "top_score"])

    return run


def _floors(carried: DataFrame, k: int) -> DataFrame:
    """(bundle, slot, floor): the k-th best score so far of the items that have k."""
    tops = carried.select("bundle", F.explode(F.arrays_zip("top_slot", "top_score")).alias("t")).select("bundle", F.col("t.top_slot").alias("slot"), F.col("t.top_score").alias("floor"))
    order = Window.partitionBy("bundle", "slot").orderBy(F.col("floor").desc())
    return tops.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).where(F.col("at") == k).drop("at")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", item_text: str = "text", owners: tuple[float, ...] = OWNERS,
           shard: int = SHARD, held: int = HELD) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = asked.mapInArrow(_item_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("repeats"))
    asked = stored(asked, "item-terms")
    known = spark.sparkContext.broadcast(bitmap(asked, "term", BITS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    postings = stored(rows.mapInArrow(_postings(known, shard, held), _POSTING), "postings")
    shards = postings.where("term is null")
    sums = shards.agg(F.sum(F.size(F.filter("n", lambda n: n > 0)).cast("long")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    documents, words = (int(x or 0) for x in sums)

    terms = postings.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    terms = terms.select("term", "times", "n").mapInArrow(_best_gain(documents, words), "term long, df long, gain long").groupBy("term").agg(F.sum("df").alias("df"), F.max("gain").alias("gain"))
    weight = F.floor(1000 * F.ln((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    owner = F.lit(len(owners) - 1)
    for j in reversed(range(len(owners) - 1)):
        owner = F.when(F.col("df") <= owners[j] * documents, j).otherwise(owner)
    terms = terms.withColumn("weight", weight).withColumn("owner", owner).where("weight > 0")

    held_items = asked.select("item_id").distinct()
    bundles = max(1, -(-held_items.count() // BUNDLE))
    within = Window.partitionBy("bundle").orderBy(F.col("item_id").asc_nulls_first())
    slots = held_items.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("long")).withColumn("slot", F.row_number().over(within) - 1)
    slots = stored(slots, "bundles")
    named = slots.select(F.col("item_id").alias("i"), "bundle", "slot")
    needs = asked.join(named, F.col("item_id").eqNullSafe(F.col("i"))).join(terms, "term").select(
        "bundle", "slot", "term", "owner", (F.col("weight") * F.col("repeats")).alias("weight"), (F.col("weight") * F.col("repeats") * F.col("gain")).alias("most"))
    needs = stored(needs, "needs")

    carried, floors = None, None
    for stage in range(len(owners)):
        later = needs.groupBy("bundle", "slot").agg(F.sum(F.when(F.col("owner") > stage, F.col("most")).otherwise(0)).alias("rest"))
        state = slots.select("bundle", "slot").join(later, ["bundle", "slot"], "left")
        state = state.join(floors, ["bundle", "slot"], "left") if floors is not None else state.withColumn("floor", F.lit(1).cast("long"))
        state = state.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("floor", F.lit(1)).alias("floor"), F.coalesce("rest", F.lit(0)).alias("rest")))).alias("s"))
        state = stored(state.select("bundle", F.col("s.floor").alias("floor"), F.col("s.rest").alias("rest")), "bundle-state")
        own = needs.where(F.col("owner") == stage).groupBy("term", "bundle").agg(F.collect_list(F.struct("slot", "weight")).alias("w"))
        own = own.select("term", "bundle", F.col("w.slot").alias("slots"), F.col("w.weight").alias("weights"))
        lists = postings.where("term is not null").join(own, "term").join(state, "bundle").select("bundle", "shard", "place", "times", "n", "slots", "weights", "floor", "rest")
        if carried is None:
            before = spark.createDataFrame([], "bundle long, shard long, slot array<int>, place array<int>, score array<long>, floor array<long>, rest array<long>")
        else:
            before = carried.drop("top_slot", "top_score").join(state.toDF("bundle", "floor", "rest"), "bundle").select("bundle", "shard", "slot", "place", "score", "floor", "rest")
        carried = stored(before.groupBy("bundle", "shard").cogroup(lists.groupBy("bundle", "shard")).applyInArrow(_stage(k, documents, words), _CARRIED), "accumulators")
        floors = _floors(carried, k)

    last = carried.select("bundle", "shard", F.explode(F.arrays_zip("slot", "place", "score")).alias("a")).select("bundle", "shard", "a.slot", "a.place", "a.score")
    last = last.join(floors, ["bundle", "slot"], "left").where(F.col("score") >= F.coalesce("floor", F.lit(1))).drop("floor")
    ids = shards.select("shard", F.posexplode("ids").alias("place", "doc_id"))
    order = Window.partitionBy("bundle", "slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
    best = last.join(ids, ["shard", "place"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(slots, ["bundle", "slot"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _sql_terms(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def sql(k: int = 10) -> str:
    return f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, {_sql_terms("text")} AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
held AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
counted AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM words) GROUP BY row, term),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_sql_terms("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), held),
scored AS (
  SELECT a.item_id, c.row, sum(a.repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked a JOIN counted c ON a.term = c.term JOIN weights t ON t.term = a.term JOIN sizes s ON s.row = c.row, held GROUP BY a.item_id, c.row),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, s.row) AS rank FROM scored JOIN sizes s ON s.row = scored.row WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {k}"""
