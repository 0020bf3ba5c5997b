"""Repeated paragraphs and passages: MinHash banding, exact Jaccard, components; the first of each component stays.

A paragraph is a line; lines of more than ``LONG`` words are cut where a hash of two neighbouring words is the smallest within ``REACH`` words on either
side, so that cuts follow the content and a passage inside lines holds the same pieces wherever it stands. Every paragraph counts; the set of fewer than
five words is their whole sequence, and sets too small to be similar to another one are compared by their names only. Paragraphs with equal
sets of 5-word shingles are one class; class signatures are banded, where ``tune_bands`` picks the cheapest bands of ``RECALL`` at the threshold; colliding classes are
confirmed on full sets and connected as near-duplicate documents are (stars, then tiles). Sets are named by 64-bit hashes.

A repeated passage may stand anywhere, also inside lines and across them: every window of ``PASSAGE`` words that stands at an earlier place
(doc_id, then text and position) goes, whatever the lines. The smallest hash of the ``GRAM`` words long pieces of a window is its anchor;
neighbouring windows with one anchor are a segment. Only segments whose anchor stands twice travel, equal ones collapse, and only where an anchor has
different segments are the windows of the first of each compared. The windows of a document join to runs of bytes; of the paragraphs that
stay, ``removed`` lists the parts that lie in a run. Every removal points to an earlier copy. Words are compared by 64-bit hashes of the windows.

One pass over the texts writes places, names, bands and anchors. Which bands and anchors two places share is found in parts by hash: each task sends a
key of a part with its least and greatest owner, and a part answers with bits of a bitmap of ``BITS`` bits. Later passes touch only what the bitmaps
let through, documents without any of it not at all. Tables are deleted when their last reader is written.

Of a component's paragraphs, the one with the smallest (doc_id, number) stays. Null and empty texts have no paragraphs; rows that
repeat a doc_id and text count as one document and get equal results; a null doc_id sorts first; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.bitmap import bitmap, contains, dense, kept, marked, marks
from curatrix.llm.neardup import _keys, collisions, connect
from curatrix.llm.storage import forget, stored
from curatrix.llm.words import blocks, distinct_by_row, hashes_of, mix, powers, shingles, word_bounds

LONG, REACH = 60, 20
RECALL = 0.9995
PASSAGE, GRAM = 50, 24
BITS = 1 << 25
HELD = 1 << 18
SURE = 0.3
_HIGH = np.uint64(32)
_BASE = np.uint64(0x9E6C63D0876A9A35)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tune_bands(threshold: float, recall: float, most_rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands are at most twice the fewest that reach ``recall`` at ``threshold``."""
    need = {r: int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** r))) for r in range(1, most_rows + 1)}
    rows = max(r for r, b in need.items() if b <= 2 * need[1])
    return need[rows], rows


BANDS, ROWS = tune_bands(0.75, RECALL)
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(500)) | np.uint64(1)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of a block, their starts and ends, and the words before each row (len + 1)."""
    starts, ends, rows = word_bounds(data, offsets)
    return hashes_of(data, starts, ends), starts, ends, rows


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value of every window of ``width`` values, by windows of doubled width."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at, span = np.where(values[left] <= values[right], left, right), span + step
    return at


def _paragraphs(data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
    """For each paragraph of a block its row, number in the row, byte range and the words before it (len + 1)."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(1, np.int64)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    first = np.zeros(len(words), bool)
    first[rows[:-1][rows[:-1] < rows[1:]]] = True
    first[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    size = np.diff(np.append(np.flatnonzero(first), len(words)))
    long = np.repeat(size > LONG, size)
    at = np.flatnonzero(long)
    if len(at):  # lines stand ``REACH`` apart, so that none decides on another's cuts
        place = np.arange(len(at)) + REACH * np.cumsum(first[at])
        pair = mix(words[at] ^ (words[at - 1] << np.uint64(1)))
        pair[first[at]] = np.iinfo(np.uint64).max
        wide = np.full(place[-1] + REACH + 1, np.iinfo(np.uint64).max, np.uint64)
        wide[place] = pair
        least = wide[_least(wide, 2 * REACH + 1)[place - REACH]]
        first[at[pair == least]] = True
    at = np.flatnonzero(first)
    bounds = np.append(at, len(words))
    row = np.searchsorted(rows, at, side="right") - 1
    number = np.arange(len(at)) - np.searchsorted(row, row)
    return row, number, starts[at], ends[bounds[1:] - 1], bounds


def _signatures(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures (sets x permutations) and band keys (sets x BANDS) of sets that are not empty."""
    signature = np.empty((len(counts) - 1, len(_A)), np.uint32)
    for k, a in enumerate(_A):
        signature[:, k] = np.minimum.reduceat(((values * a) >> _HIGH).astype(np.uint32), counts[:-1])
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        bands = mix(bands ^ parts[:, :, r])
    return signature, bands


def _taken(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``at`` of ragged values, and their bounds."""
    size = np.diff(counts)[at]
    ends = np.cumsum(size)
    return values[np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(counts[:-1][at], size)], np.concatenate(([0], ends))


def _scan(percent: int):
    """The one pass over all texts: paragraphs with the names of their sets, bands of each different set of a block, anchors of each document."""

    def run(batches):
        for batch in batches:
            for start, to, data, offsets in blocks(batch.column("text")):
                words, starts, ends, rows = _words(data, offsets)
                row, number, begin, end, bounds = _paragraphs(data, words, starts, ends, rows)
                n = len(row)
                values, counts = distinct_by_row(*shingles(words, bounds))
                size = np.diff(counts)
                key = _keys(values, counts)[0] if n else np.zeros(0, np.int64)
                _, once = np.unique(key, return_index=True)
                once = once[100 * size[once] >= percent * (size[once] + 1)]
                bands = np.full(n, None, object)
                if len(once):
                    for i, line in zip(once, _signatures(*_taken(values, counts, once))[1]):
                        bands[i] = line.tobytes()
                anchor, _, first, _, _, _ = _anchored(words, rows)
                owner = np.searchsorted(rows, first, side="right") - 1
                cut = np.searchsorted(owner, np.arange(to - start + 1))
                held = np.flatnonzero(np.diff(cut))
                doc = pa.array(np.concatenate((start + row, start + held)))
                extra = len(held)

                def padded(column: np.ndarray) -> pa.Array:
                    return pa.array(np.concatenate((column, np.zeros(extra, np.int64))), mask=np.arange(n + extra) >= n)  # noqa: B023

                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("text_key").take(doc), padded(number), padded(begin - offsets[row]), padded(end - offsets[row]), padded(key),
                     pa.array([*bands, *[None] * extra], pa.binary()), pa.array([*[None] * n, *[anchor[cut[i]:cut[i + 1]].tobytes() for i in held]], pa.binary())],
                    names=["doc_id", "text_key", "number", "begin", "end", "k1", "bands", "anchors"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a column of byte strings, and the values before each row (len + 1); nulls have none."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), np.uint64), (offsets - offsets[0]) // 8


class _Parts:
    """Keys with the least and greatest of their owners, by part, as they gather in a task. Keys are turned so that their bit leads."""

    def __init__(self, parts: int, kind: int, bits: int):
        self.parts, self.kind, self.low, self.held, self.rows = parts, kind, np.uint64(bits.bit_length() - 1), 0, []

    def add(self, keys: np.ndarray, owners: np.ndarray) -> None:
        self.rows.append(((keys << (np.uint64(64) - self.low)) | (keys >> self.low), owners))
        self.held += len(keys)

    def flush(self):
        if self.held:
            keys, owners = (np.concatenate(x) for x in zip(*self.rows))
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            columns = keys[first], np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
            edges = (np.arange(1, self.parts, dtype=np.uint64) << np.uint64(64 - (self.parts - 1).bit_length()))
            cut = np.concatenate(([0], np.searchsorted(columns[0], edges), [len(first)]))
            some = np.flatnonzero(np.diff(cut))
            lists = [[x[cut[p]:cut[p + 1]].tobytes() for p in some] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), self.kind, np.int32)), pa.array(some.astype(np.int32)), *[pa.array(x, pa.binary()) for x in lists]],
                                             names=["kind", "part", "keys", "low", "high"])
        self.held, self.rows = 0, []


def _dealt(parts: int, bits: int):
    """Band keys owned by sets (kind 0), anchors owned by places (kind 1) and names of sets owned by paragraphs (kind 2), by part."""

    def run(batches):
        bands, anchors, names = (_Parts(parts, kind, bits) for kind in range(3))
        for batch in batches:
            own = batch.filter(batch.column("number").is_valid())
            spot = marks(own.column("doc_id"), own.column("text_key"), own.column("number"))
            names.add(own.column("k1").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), spot)
            keys, cut = _flat(batch.column("bands"))
            if len(keys):
                owners = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
                bands.add(keys, np.repeat(owners, np.diff(cut)))
            keys, cut = _flat(batch.column("anchors"))
            if len(keys):
                place = np.arange(len(keys)) - np.repeat(cut[:-1], np.diff(cut))
                doc = np.repeat(marks(batch.column("doc_id"), batch.column("text_key")), np.diff(cut))
                anchors.add(keys, mix(doc ^ place.astype(np.uint64)))
            for held in (bands, anchors, names):
                if held.held >= HELD:
                    yield from held.flush()
        for held in (bands, anchors, names):
            yield from held.flush()

    return run


def _twice(bits: int):
    """Bits of the keys of a part that have two owners, as words of the bitmap."""
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(key, table):
        keys, low, high = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("keys", "low", "high"))
        order = np.argsort(keys)
        keys, low, high = keys[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        several = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)
        spot = keys[first][several] >> shift
        word, at = np.unique((spot >> np.uint64(6)).astype(np.int64), return_inverse=True)
        mask = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(mask, at, np.uint64(1) << (spot & np.uint64(63)))
        return pa.table({"kind": pa.array(np.full(len(word), key[0].as_py(), np.int32)), "word": pa.array(word.astype(np.int32)), "mask": pa.array(mask.view(np.int64))})

    return run


def _shared(units: DataFrame, parts: int) -> np.ndarray:
    """Bitmaps of the bands of two sets, of the anchors of two places and of the names of two paragraphs; a hot key is two numbers a task."""
    parts = 1 << max(4, (parts - 1).bit_length())
    dealt = units.select("doc_id", "text_key", "number", "k1", "bands", "anchors").mapInArrow(_dealt(parts, BITS), "kind int, part int, keys binary, low binary, high binary")
    words = dealt.groupBy("kind", "part").applyInArrow(_twice(BITS), "kind int, word int, mask long")
    return dense(words, BITS, 3)


def _hits(known):
    """(band, rep) of the sets with a band in the bitmap."""

    def run(batches):
        for batch in batches:
            if len(batch):
                bands = _flat(batch.column("bands"))[0].reshape(len(batch), -1)
                hit = contains(known.value, bands.ravel()).reshape(bands.shape)
                row, _ = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(bands[hit].view(np.int64)), batch.column("k1").take(pa.array(row))], names=["band", "rep"])

    return run


def _chosen(batch: pa.RecordBatch, known) -> pa.RecordBatch:
    """The documents of a batch that may be in a bitmap of (doc_id, text_key)."""
    return batch.filter(pa.array(contains(known.value, marks(batch.column("doc_id"), batch.column("text_key")))))


def _members(documents, places):
    """Name, signature and values of the sets of the paragraphs in the bitmap ``places``, of documents in ``documents``."""

    def run(batches):
        for batch in batches:
            batch = _chosen(batch, documents)
            doc = marks(batch.column("doc_id"), batch.column("text_key"))
            for start, _, data, offsets in blocks(batch.column("text")):
                words, *where = _words(data, offsets)
                row, number, _, _, bounds = _paragraphs(data, words, *where)
                at = np.flatnonzero(contains(places.value, mix(doc[start + row] ^ number.astype(np.uint64))))
                if len(at):
                    values, counts = distinct_by_row(*shingles(*_taken(words, bounds, at)))
                    signature, _ = _signatures(values, counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_keys(values, counts)[0]), pa.array([x.tobytes() for x in signature], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(values.view(np.int64)))], names=["rep", "signature", "items"])

    return run


def _named(total: np.ndarray, inverse: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from ``first`` to before ``end``; they don't depend on the place."""
    return mix((total[end] - total[first]) * inverse[first] ^ mix((end - first).astype(np.uint64)))


def _anchored(words: np.ndarray, rows: np.ndarray):
    """Segments of a block: anchor, name, first window and number of windows; and the parts of ``_named``."""
    n = len(words)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(n, _BASE), dtype=np.uint64)))
    inverse = powers(n, _INVERSE)
    place = np.arange(n)
    place = place[place + PASSAGE <= np.repeat(rows[1:], np.diff(rows))]
    if not len(place):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, total, inverse
    at = np.arange(n - GRAM + 1)
    gram = _named(total, inverse, at, at + GRAM)
    pick = _least(gram, PASSAGE - GRAM + 1)[place]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (pick[1:] != pick[:-1]) | (place[1:] != place[:-1] + 1)
    cut = np.flatnonzero(fresh)
    first, count = place[cut], np.diff(np.append(cut, len(place)))
    return gram[pick[cut]], _named(total, inverse, first, first + count - 1 + PASSAGE), first, count, total, inverse


def _places(known, documents, single: bool):
    """Segments whose anchor is in the bitmap ``known``; if ``single``, the windows of the segments whose mark is in it. Only ``documents`` are read."""

    def run(batches):
        for batch in batches:
            batch = _chosen(batch, documents)
            doc = marks(batch.column("doc_id"), batch.column("text_key"))
            for start, _, data, offsets in blocks(batch.column("text")):
                words, starts, ends, rows = _words(data, offsets)
                anchor, name, first, count, total, inverse = _anchored(words, rows)
                row = np.searchsorted(rows, first, side="right") - 1
                mark = mix(name ^ mix(doc[start + row] ^ mix((first - rows[row]).astype(np.uint64))))
                hit = np.flatnonzero(contains(known.value, mark if single else anchor))
                if not len(hit):
                    continue
                anchor, name, first, count, row, mark = (x[hit] for x in (anchor, name, first, count, row, mark))
                end = first + count - 1 + PASSAGE
                if single:
                    size = np.cumsum(count)
                    first = np.arange(int(size[-1])) - np.repeat(size - count, count) + np.repeat(first, count)
                    row, mark, end = np.repeat(row, count), np.repeat(mark, count), first + PASSAGE
                    anchor = name = _named(total, inverse, first, end)
                _, number, _, _, bounds = _paragraphs(data, words, starts, ends, rows)
                number = number[np.searchsorted(bounds, first, side="right") - 1]
                own = pa.array(start + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(number),
                     pa.array(starts[first] - offsets[row]), pa.array(ends[end - 1] - offsets[row]), pa.array(mark.view(np.int64))],
                    names=["anchor", "name", "doc_id", "text_key", "number", "begin", "end", "mark"])

    return run


_PLACE = "anchor long, name long, doc_id long, text_key long, number long, begin long, end long, mark long"


def _with_anchor(known):
    """Marks of the documents with an anchor in the bitmap."""

    def run(batches):
        for batch in batches:
            keys, cut = _flat(batch.column("anchors"))
            hits = np.concatenate(([0], np.cumsum(contains(known.value, keys))))
            found = marks(batch.column("doc_id"), batch.column("text_key"))[hits[cut[1:]] > hits[cut[:-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["mark"])

    return run


def _passages(rows: DataFrame, anchored: DataFrame, anchors: np.ndarray) -> DataFrame:
    """(d, t, runs) of the documents with repeated passages: runs of bytes, each with the id and paragraph of an earlier copy. A stored table."""
    spark = rows.sparkSession

    def known(keys: DataFrame, column: str):
        return spark.sparkContext.broadcast(bitmap(keys, column, BITS))

    place = F.struct("doc_id", "text_key", "begin", "number", "mark")

    def copies(found: DataFrame) -> DataFrame:
        return found.where(~place.eqNullSafe(F.col("first"))).select(
            "doc_id", "text_key", "begin", "end", F.col("first.doc_id").alias("keeper_id"), F.col("first.number").alias("keeper_number"))

    ends = [F.min(place).alias("first"), F.max(place).alias("last")]
    shared = spark.sparkContext.broadcast(anchors)
    # one Python function a stage: each further one would be a worker of its own beside it in every task
    documents = known(anchored.mapInArrow(_with_anchor(shared), "mark long"), "mark")
    segments = stored(rows.mapInArrow(_places(shared, documents, False), _PLACE), "segments")
    classes = stored(segments.groupBy("anchor", "name").agg(*ends), "segment-classes")
    mixed = classes.groupBy("anchor").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a != b").select("anchor")
    firsts = stored(classes.join(mixed, "anchor").select("first.mark", "first.doc_id", "first.text_key"), "mixed")
    windows = rows.mapInArrow(_places(known(firsts, "mark"), known(marked(firsts, "doc_id", "text_key"), "mark"), True), _PLACE)
    windows = windows.drop("anchor").withColumn("first", F.min(place).over(Window.partitionBy("name")))  # nearly all names stand once, so nothing would collapse before the shuffle
    windows = stored(copies(windows), "windows")
    again = classes.where(~F.col("first").eqNullSafe(F.col("last"))).select("anchor", "name", "first")
    cut = copies(segments.join(again, ["anchor", "name"])).unionByName(windows)
    # the first row of a run has its least (begin, keeper): no struct is aggregated, which would need a sort
    before = Window.partitionBy("doc_id", "text_key").orderBy("begin", "keeper_id", "keeper_number")
    opens = F.coalesce(F.col("begin") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    cut = cut.withColumn("opens", opens).withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    opening = [F.max(F.when(F.col("opens") == 1, F.col(c))).alias(c) for c in ("begin", "keeper_id", "keeper_number")]
    runs = cut.groupBy("doc_id", "text_key", "run").agg(*opening, F.max("end").alias("end"))
    out = stored(runs.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(
        F.collect_list(F.struct("begin", "end", "keeper_id", "keeper_number")).alias("runs")), "runs")
    forget(segments, classes, firsts, windows)
    return out


def repeated_paragraphs(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_paragraphs, n_removed, removed (number, begin and end in UTF-8 bytes, keeper_id, keeper_number).

    An entry of ``removed`` is a whole paragraph, or the part of one that lies in a repeated passage.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    scanned = stored(rows.mapInArrow(_scan(percent), "doc_id long, text_key long, number long, begin long, end long, k1 long, bands binary, anchors binary"), "paragraphs")
    share = spark.sparkContext.broadcast

    def know(keys: DataFrame, *columns: str):
        """A broadcast bitmap of one column, or of the marks of several."""
        return share(bitmap(marked(keys, *columns), "mark", BITS) if len(columns) > 1 else bitmap(keys, columns[0], BITS))

    bands, anchors, names = _shared(scanned, max(16, 2 * rows.rdd.getNumPartitions()))
    passages = _passages(rows, scanned.where("anchors is not null").select("doc_id", "text_key", "anchors"), anchors)
    hits = scanned.where("bands is not null").select("k1", "bands").mapInArrow(_hits(share(bands)), "band long, rep long")
    members = collisions(hits.distinct())
    units = stored(scanned.where("number is not null").drop("bands", "anchors"), "units")
    forget(scanned)

    wanted = members.select(F.col("rep").alias("k1")).distinct()
    places = kept(units.select("k1", "doc_id", "text_key", "number"), know(wanted, "k1"), "k1").join(wanted, "k1").groupBy("k1").agg(F.min(F.struct("doc_id", "text_key", "number")).alias("p"))
    places = stored(places.select("p.*"), "places")
    documents, spots = know(places, "doc_id", "text_key"), know(places, "doc_id", "text_key", "number")
    found = rows.mapInArrow(_members(documents, spots), "rep long, signature binary, items array<long>").join(wanted.withColumnRenamed("k1", "rep"), "rep")
    sets = stored(found.groupBy("rep").agg(F.first("signature").alias("signature"), F.first("items").alias("items")), "sets")
    home = stored(connect(sets.select("rep", "signature"), members, sets, percent, sure=SURE), "home")
    forget(places, sets)

    # paragraphs whose set stands twice or has a similar one; rows that repeat a document and its text are one document
    linked = know(home, "node")
    again = rows.select("doc_id", "text_key").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    once = units.distinct() if again else units
    some = stored(kept(once, share(names | linked.value), "k1"), "repeated")
    classes = some.groupBy(F.col("k1").alias("rep")).agg(F.count("*").alias("copies"))
    open_classes = classes.join(home.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null").select(
        F.col("rep").alias("k1"), F.coalesce("component", "rep").alias("component"))
    told = stored(some.join(open_classes, "k1"), "told")
    keeper = told.groupBy("component").agg(F.min(F.struct("doc_id", "number", "text_key")).alias("keeper"))
    gone = told.join(keeper, "component").where(~F.struct("doc_id", "number", "text_key").eqNullSafe(F.col("keeper")))
    gone = stored(gone.select("doc_id", "text_key", "number", "begin", "end", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.number").alias("keeper_number")), "gone")
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("text_key") == F.col("t")]
    whole = gone.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("number").alias("n"))
    parts = kept(once.drop("k1"), know(passages.withColumnsRenamed({"d": "doc_id", "t": "text_key"}), "doc_id", "text_key"), "doc_id", "text_key").join(passages, same[0] & same[1]).drop("d", "t").withColumn(
        "run", F.explode(F.filter("runs", lambda r: (r["begin"] < F.col("end")) & (r["end"] > F.col("begin")))))
    parts = parts.select("doc_id", "text_key", "number", F.greatest("begin", "run.begin").alias("begin"), F.least("end", "run.end").alias("end"), "run.keeper_id", "run.keeper_number")
    parts = parts.join(whole, same[0] & same[1] & (F.col("number") == F.col("n")), "left_anti")
    removed = gone.unionByName(parts).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(
        "number", "begin", "end", "keeper_id", "keeper_number"))).alias("removed"))
    sizes = units.groupBy("doc_id", "text_key").agg((F.max("number") + 1).alias("n_paragraphs"))
    found = sizes.join(removed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "removed"),
                       F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").drop("d", "t")
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_paragraphs", "removed")
    out = rows.select("doc_id", "text_key").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = F.array().cast(removed.schema["removed"].dataType)
    return out.select("doc_id", "text_key", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"),
                      F.coalesce("removed", none).alias("removed"))
