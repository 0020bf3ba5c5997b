"""Near-duplicate documents by min-max hashing.

Every permutation of a document's 5-word shingles gives two values, its minimum and its maximum, so 64 permutations make 128
signature values. Bands of four values (two minima, two maxima) collect candidates: 32 bands miss a pair at similarity 0.75
with a chance of 5e-6. All links are confirmed on full shingle sets.

Equal sets form one class first; only class representatives take part in what follows. In a band's bucket every class meets the
bucket's smallest class (a star, linear in the bucket), and components follow. Where a bucket then still holds several
components, the classes outside its largest one are compared with that one and among themselves, in tiles of two blocks of ``BLOCK``
classes: tiles are tasks of their own, compare signatures first, then sets, skip what is already connected, and return at most a
spanning forest. A family of copies is never compared within itself.

Null or blank texts have no shingles and link with nothing; repeated rows fall in one class; rows that share a doc_id but have different
sets are classes of their own, each with the smallest doc_id of its component; a row without doc_id links with nothing and is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.bitmap import bitmap, contains, marked, marks
from curatrix.llm.graph import components
from curatrix.llm.storage import forget, stored
from curatrix.llm.words import blocks, distinct_by_row, mix, shingles, word_hashes

PERMUTATIONS = 64
BANDS = 32
BLOCK = 512
LOT = 4096
SURE = 0.58
BITS = 1 << 26
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_HIGH = np.uint64(32)
_ONE = np.uint64(1)


def minmax(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each row's values under each permutation, as n x 128 uint32; rows must not be empty."""
    out = np.empty((len(rows) - 1, 2 * PERMUTATIONS), np.uint32)
    for k, a in enumerate(_A):
        turned = (values * a) >> _HIGH
        turned = turned.astype(np.uint32)
        out[:, k] = np.minimum.reduceat(turned, rows[:-1])
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(turned, rows[:-1])
    return out


def _sets(column: pa.Array):
    for at, to, data, offsets in blocks(column):
        values, rows = distinct_by_row(*shingles(*word_hashes(data, offsets)))
        yield at, to, values, rows


def _keys(values: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit sums that together name a set."""
    out = []
    for salt in (0x51, 0xA7):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((total[rows[1:]] - total[rows[:-1]]).view(np.int64))
    return out


def _features(batches):
    for batch in batches:
        for at, to, values, rows in _sets(batch.column("text")):
            n = np.diff(rows)
            full = np.flatnonzero(n)
            signatures: list = [None] * len(n)
            if len(full):
                for i, row in zip(full, minmax(values, np.concatenate((rows[full], rows[-1:])))):
                    signatures[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, to - at), batch.column("text_key").slice(at, to - at), pa.array(n), *map(pa.array, _keys(values, rows)), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_key", "n", "k1", "k2", "signature"])


def _full_sets(known):
    """Keys and sets of the documents whose id may be in the bitmap ``known``."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(contains(known.value, marks(batch.column("doc_id")))))
            for _, _, values, rows in _sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, _keys(values, rows)), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values.view(np.int64)))], names=["k1", "k2", "items"])

    return run


def _bands(batches):
    for batch in batches:
        if not len(batch):
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(batch), -1).astype(np.uint64)
        half, step = PERMUTATIONS, PERMUTATIONS // BANDS
        for band in range(BANDS):
            low = [band * step, band * step + 1]
            high = [half + (x + half // 2) % half for x in low]
            key = np.full(len(batch), band, np.uint64)
            for place in low + high:
                key = mix(key ^ values[:, place])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("rep")], names=["band", "rep"])


def _linked(n_both, n_left, n_right, percent):
    return 100 * n_both >= percent * (n_left + n_right - n_both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (hub, rep) pairs whose full sets are similar enough; a member's set travels once for each of its hubs."""
    member = sets.select(F.col("rep"), F.col("items").alias("items"))
    hub = sets.select(F.col("rep").alias("hub"), F.col("items").alias("hub_items"))
    both = F.size(F.array_intersect("items", "hub_items"))
    n, m = F.size("items"), F.size("hub_items")
    return pairs.join(member, "rep").join(hub, "hub").where(
        (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (100 * both >= percent * (n + m - both))).select("hub", "rep")


TILE_KEYS = ["band", "kind", "i", "j"]
TILE_PAIRS = 1 << 20


def _alike(signatures: np.ndarray, follow: np.ndarray, apart, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with j at most ``follow[i]`` after i that are ``apart`` and agree in a share ``sure`` of their signatures, by i, then j."""
    pairs, step, at = [], 1, np.flatnonzero(follow > 0)
    while len(at):
        left = at[apart(at, at + step)]
        left = left[(signatures[left] == signatures[left + step]).sum(axis=1) / signatures.shape[1] >= sure]
        pairs.append(np.column_stack((left, left + step)))
        step += 1
        at = at[follow[at] >= step]
    i, j = np.concatenate(pairs).T if pairs else np.zeros((2, 0), np.int64)
    order = np.lexsort((j, i))
    return i[order], j[order]


def _tile(percent: int, sure: float = SURE):
    """Links of all tiles of a lot; a tile is the rows of one (band, kind, i, j)."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [frame[c].to_numpy() for c in (*TILE_KEYS, "rep")]
        order = np.lexsort(columns[::-1])
        fresh, new = (np.ones(len(order), bool) for _ in range(2))
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns[:-1]], axis=0)
        fresh[1:] = new[1:] | (columns[-1][order[1:]] != columns[-1][order[:-1]])
        order, cuts = order[fresh], np.append(np.flatnonzero(new[fresh]), np.count_nonzero(fresh))
        kind, rep, side, home, sets, signatures = (frame[c].to_numpy()[order] for c in ("kind", "rep", "block", "component", "items", "signature"))
        signatures = np.frombuffer(b"".join(signatures), np.uint32).reshape(len(order), -1)
        size, first = np.array([len(x) for x in sets]), cuts[:-1]
        crossing = np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)
        follow = np.repeat(np.where(crossing | (kind[first] != 0), cuts[1:], 0), np.diff(cuts)) - np.arange(len(order)) - 1
        crossing = np.repeat(crossing, np.diff(cuts))
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def apart(i, j):
            return (home[i] != home[j]) & ~(crossing[i] & (side[i] == side[j])) & (np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j]))

        found = []
        pairs = np.cumsum(np.diff(cuts) ** 2)
        for run in np.split(np.arange(len(first)), np.flatnonzero(np.diff(pairs // TILE_PAIRS)) + 1):  # runs of tiles, so that the pairs in memory are bounded
            start, end = cuts[run[0]], cuts[run[-1] + 1]
            for i, j in zip(*(x.tolist() for x in _alike(signatures[start:end], follow[start:end], lambda i, j: apart(i + start, j + start), sure))):  # noqa: B023
                i, j = i + start, j + start
                a, b = find(home[i]), find(home[j])
                if a == b:
                    continue
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                if _linked(np.count_nonzero(both[1:] == both[:-1]), len(sets[i]), len(sets[j]), percent):
                    root[max(a, b)] = min(a, b)
                    found.append((rep[i], rep[j]))
        return pd.DataFrame(found, columns=["hub", "rep"], dtype="int64")

    return links


def collisions(bands: DataFrame) -> DataFrame:
    """(band, rep, size, hub) of the bands that several classes share, from distinct (band, rep); the hub is the smallest class. A stored table."""
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    return stored(bands.join(shared, "band"), "members")


def connect(classes: DataFrame, members: DataFrame, sets: DataFrame, percent: int, sure: float = SURE) -> DataFrame:
    """(node, component) of the classes (rep, signature) that link to others.

    ``members`` is a table of ``collisions``, ``sets`` a stored table of the full sets (rep, items) of its classes; both are deleted here. Stars first, best
    hub first, then the other hubs, then tiles of what is still apart in a bucket.
    """
    votes = members.where("hub != rep").groupBy("rep", "hub").count()
    best = votes.groupBy("rep").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    links = stored(_confirmed(best, sets, percent), "links")
    home, first = components(links, "hub", "rep"), links

    def placed(pairs: DataFrame, key: str, name: str, where: DataFrame) -> DataFrame:
        where = where.select(F.col("node").alias(key), F.col("component").alias(name))
        return pairs.join(where, key, "left").withColumn(name, F.coalesce(name, key))

    open_votes = placed(placed(votes, "rep", "c", home), "hub", "d", home).where("c != d").select("hub", "rep")
    links = stored(links.unionByName(_confirmed(open_votes, sets, percent)), "links")
    forget(first)
    home = stored(components(links, "hub", "rep"), "home")

    apart = placed(members.select("band", "rep", "size"), "rep", "component", home)
    parts = apart.groupBy("band", "component").agg(F.count("*").alias("n"))
    open_bands = parts.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.max("n").alias("n_core"), F.sum("n").alias("n")).where("n > n_core")
    placed_rows = (apart.join(open_bands, "band").withColumn("inside", F.col("component") == F.col("core"))
                   .withColumn("core_blocks", F.ceil(F.col("n_core") / BLOCK).cast("int")).withColumn("rest_blocks", F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int"))
                   .withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("core_blocks")).otherwise(F.col("rest_blocks"))).cast("int")))
    across = placed_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("rest_blocks")).otherwise(F.col("core_blocks")) - 1))).select(
        "band", "rep", "component", F.col("inside").cast("int").alias("block"), F.lit(0).alias("kind"),
        F.when(F.col("inside"), F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("inside"), F.col("other")).otherwise(F.col("block")).alias("j"))
    beside = placed_rows.where("not inside").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1))).select(
        "band", "rep", "component", "block", F.lit(1).alias("kind"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = stored(across.unionByName(beside), "tiles")
    lots = max(1, -(-tiles.count() // LOT))  # small tiles share a task's batch, which is bounded in rows
    rest = tiles.join(classes.select("rep", "signature"), "rep").join(sets.select("rep", "items"), "rep")
    more = rest.groupBy(F.pmod(F.xxhash64(*TILE_KEYS), F.lit(lots)).alias("lot")).applyInPandas(_tile(percent, sure), "hub long, rep long")
    out = components(links.unionByName(more), "hub", "rep")
    forget(members, sets, links, home, tiles)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is that document),
    component (a number for it, null where nothing can link) and text_key (xxhash64 of the text).

    ``doc_id`` must be an integer. Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    features = stored(ids.mapInArrow(_features, "doc_id long, text_key long, n long, k1 long, k2 long, signature binary"), "minmax")
    named = features.where("n > 0 and doc_id is not null")
    classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    members = collisions(classes.select("rep", "signature").mapInArrow(_bands, "band long, rep long"))
    wanted = classes.join(members.select("rep").distinct(), "rep").select("k1", "k2", "rep", "doc_id")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(marked(wanted, "doc_id"), "mark", BITS))
    sets = ids.where("doc_id is not null").select("doc_id", "text").mapInArrow(_full_sets(known), "k1 long, k2 long, items array<long>").join(wanted.drop("doc_id"), ["k1", "k2"])
    sets = stored(sets.select("rep", "items").dropDuplicates(["rep"]), "sets")
    home = connect(classes.select("rep", "signature"), members, sets, percent)
    return _labelled(features, classes, home)


def _labelled(features: DataFrame, classes: DataFrame, home: DataFrame) -> DataFrame:
    """Every row of ``features`` with the smallest doc_id of its component; small classes are joined by their keys."""
    placed = classes.select("k1", "k2", "rep", "doc_id").join(home.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = placed.join(least, "component").select("k1", "k2", "component_id", "component")
    out = features.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "k1", "k2").join(final, ["k1", "k2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumns({"component_id": F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")), "component": F.when(linked, F.col("component"))})
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "text_key")
