"""Repeated byte strings of a collection by column-wise suffix sorting.

The question: which bytes are covered by a string of ``LENGTH`` bytes that also starts elsewhere? Windows of that length are dealt to tasks by
their minimizer (the k-gram of least hash in the window, leftmost on ties). Consecutive windows with one minimizer are a segment, so text
travels about once for every 85 windows. Equal windows have their minimizer at the same distance: segments of a task are aligned by
it, and a window can only equal windows at its own column.

In a task the segments are the documents of a collection whose suffixes are sorted column by column from the right: each round inserts
one symbol of every document in front of its suffix, turns the order of the column before (a stable sort by symbol, which is the column's
block of the collection's Burrows-Wheeler transform) and updates the common prefixes (one more than the least between two neighbours,
or nothing). The symbols lie in an external file, column after column, and are read once, in sequence; in memory stay one order and one prefix array.
Two neighbours with a common prefix of ``LENGTH`` are a repeat.

Before that: minimizers seen once are left out through a fixed-size bitmap; equal segments (128-bit hashes) are one document of
the collection with a count, so a group of copies is one row. A minimizer with more than ``HOT`` different segments is split by hash; the
parts' different windows then meet by 128-bit hashes, each part giving every window once.

Null texts are empty; texts under ``LENGTH`` bytes keep all; repeated rows are repeats of each other; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.bitmap import bitmap, contains
from curatrix.llm.storage import stored
from curatrix.llm.words import mix, powers, text_arrays

LENGTH, GRAM = 200, 32
BITS = 1 << 25
CHUNK = 1 << 20
HOT = 4096
ROWS = 40_000
_PLACE = np.uint64((1 << 24) - 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TABLES = tuple(mix(np.arange(256, dtype=np.uint64) + np.uint64(s)) for s in (3000, 9000))


@lru_cache(4)
def _scales(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[which])
    return powers(n, np.uint64(base)), powers(n, np.uint64(pow(base, -1, 1 << 64)))


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, and what makes differences of them independent of the place."""
    size = 1 << max(12, int(len(data) + 1).bit_length())
    up, down = _scales(which, size)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * up[:len(data)], dtype=np.uint64))), down


def _hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = sums
    return mix((total[end] - total[start]) * down[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from minima forward and backward in blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _chunks(column: pa.Array):
    """(first row, bytes, offsets, place of the first byte in its row): runs of rows, or parts of one long row that overlap by a window."""
    data, offsets = text_arrays(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        size = int(offsets[to] - offsets[at])
        if to > at + 1 or size <= 2 * CHUNK:
            yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], 0
        else:
            for cut in range(0, size - LENGTH + 1, CHUNK):
                part = data[offsets[at] + cut:min(offsets[at] + cut + CHUNK + LENGTH - 1, offsets[to])]
                yield at, part, np.array([0, len(part)]), cut
        at = to


def segments(data: np.ndarray, offsets: np.ndarray):
    """Row, first byte, number of windows, minimizer's place and hash of all segments of a chunk."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64), None
    sums = total, down = _sums(data, 0)
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[:len(data) - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = (_least((grams & ~_PLACE) | place, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    inside[offsets[long]] += 1
    np.add.at(inside, offsets[long + 1] - LENGTH + 1, -1)
    valid = np.cumsum(inside)[:len(least)] > 0
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    opens[offsets[long]] = True
    first = np.flatnonzero(opens)
    stop = np.minimum(np.append(first[1:], len(least)), offsets[np.searchsorted(offsets, first, side="right")] - LENGTH + 1)
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, stop - first, least[first], grams[least[first]], sums


def _grams(batches):
    for batch in batches:
        for _, data, offsets, _ in _chunks(batch.column("text")):
            found, count = np.unique(segments(data, offsets)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["gram", "n"])


def _occurrences(known):
    """Segments whose minimizer may repeat: their place, names and text."""

    def run(batches):
        for batch in batches:
            for start, data, offsets, shift in _chunks(batch.column("text")):
                row, first, n, spot, gram, sums = segments(data, offsets)
                hit = np.flatnonzero(contains(known.value, gram))
                if not len(hit):
                    continue
                row, first, n, spot, gram = (x[hit] for x in (row, first, n, spot, gram))
                end = first + n + LENGTH - 1
                left = spot - first
                salt = mix(left.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))
                names = [mix(_hashes(s, first, end) ^ salt).view(np.int64) for s in (sums, _sums(data, 1))]
                size = end - first
                ends = np.cumsum(size)
                at = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(first, size)
                texts = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data[at])])
                own = pa.array(start + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(first - offsets[row] + shift), pa.array(n), pa.array(left),
                     pa.array(gram.view(np.int64)), *map(pa.array, names), texts], names=["doc_id", "text_key", "first", "n", "left", "gram", "s1", "s2", "body"])

    return run


class Collection:
    """Aligned documents on disk, one column after the other within each batch."""

    def __init__(self, folder: str):
        self.file = tempfile.TemporaryFile(dir=folder)
        self.blocks: list[tuple[int, int]] = []
        self.width = 2 * LENGTH - GRAM
        self.begin: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, left: np.ndarray) -> None:
        rows, begin = len(left), LENGTH - GRAM - left
        grid = np.zeros((rows, self.width), np.uint8)
        size = np.diff(offsets)
        grid[np.repeat(np.arange(rows), size), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0] - begin, size)] = data[offsets[0]:offsets[-1]]
        self.blocks.append((self.file.seek(0, 2), rows))
        self.file.write(np.ascontiguousarray(grid.T[::-1]).tobytes())
        self.begin.append(begin)
        self.size.append(size)

    def column(self, j: int) -> np.ndarray:
        out = []
        for base, rows in self.blocks:
            self.file.seek(base + (self.width - 1 - j) * rows)
            out.append(np.frombuffer(self.file.read(rows), np.uint8))
        return np.concatenate(out)


def repeats(collection: Collection, group: np.ndarray):
    """Round by round (column, rows in suffix order, whether a row's window there repeats, whether it is the first of its equals)."""
    begin, end = np.concatenate(collection.begin), np.concatenate(collection.begin) + np.concatenate(collection.size)
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(len(order), np.int64)
    for j in range(collection.width - 1, -1, -1):
        symbol = np.where((begin <= j) & (j < end), collection.column(j).astype(np.int64) + 1, 0)
        key = (group * 512 + symbol)[order]
        turned = np.argsort(key, kind="stable")
        key = key[turned]
        same = np.zeros(len(order), bool)
        same[1:] = (key[1:] == key[:-1]) & (key[1:] % 512 > 0)
        at = np.flatnonzero(same)
        fresh = np.zeros(len(order), np.int64)
        if len(at):
            pairs = np.column_stack((turned[at - 1] + 1, turned[at] + 1)).ravel()
            fresh[at] = np.minimum(np.minimum.reduceat(np.append(prefix, 0), pairs)[::2] + 1, LENGTH)
        order, prefix = order[turned], fresh
        like = prefix >= LENGTH
        twin = like.copy()
        twin[:-1] |= like[1:]
        yield j, order, twin, ~like & ((end - j)[order] >= LENGTH) & (j >= begin)[order]


def _sorted_columns(batches):
    """Flags of the repeated windows of each class of a task, and the different windows of hot groups."""
    import os
    folder = os.environ.get("TMPDIR") or tempfile.gettempdir()
    collection, names = Collection(folder), []
    for batch in batches:
        if not len(batch):
            continue
        body = batch.column("body")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        collection.add(np.frombuffer(body.buffers()[2], np.uint8), offsets, batch.column("left").to_numpy())
        names.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "part", "s1", "s2", "n", "hot")]))
    if not names:
        return
    names = np.concatenate(names)
    begin, n, hot = np.concatenate(collection.begin), names[:, 4], names[:, 5] > 0
    _, group = np.unique(names[:, :2], axis=0, return_inverse=True)
    flags = np.zeros((len(n), LENGTH - GRAM + 1), bool)
    heads = np.zeros_like(flags) if hot.any() else None
    for j, order, twin, head in repeats(collection, group.ravel()):
        rows = order[twin]
        flags[rows, j - begin[rows]] = True
        if heads is not None:
            rows = order[head]
            rows = rows[hot[rows]]
            heads[rows, j - begin[rows]] = True
    yield from _flag_batches(names, flags)
    if heads is not None:
        yield from _window_batches(collection, names, begin, flags, heads)


_FLAGS = "gram long, s1 long, s2 long, flags binary, w1 long, w2 long, spot int, alone boolean"


def _flag_batches(names: np.ndarray, flags: np.ndarray):
    packed = np.packbits(flags, axis=1)
    for at in range(0, len(names), 10_000):
        part = names[at:at + 10_000]
        m = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 2]), pa.array(part[:, 3]), pa.array([r.tobytes() for r in packed[at:at + m]], pa.binary()),
                                          pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_())],
                                         names=["gram", "s1", "s2", "flags", "w1", "w2", "spot", "alone"])


def _window_batches(collection: Collection, names: np.ndarray, begin: np.ndarray, flags: np.ndarray, heads: np.ndarray):
    """The different windows of hot groups of this part: hash, place, and whether the part has it once."""
    base = 0
    for place, rows in collection.blocks:
        collection.file.seek(place)
        grid = np.frombuffer(collection.file.read(rows * collection.width), np.uint8).reshape(collection.width, rows)[::-1].T
        chosen = np.flatnonzero(heads[base:base + rows].any(axis=1))
        for i in range(0, len(chosen), 2000):
            some = chosen[i:i + 2000]
            flat = np.ascontiguousarray(grid[some]).ravel()
            row, spot = np.nonzero(heads[base + some])
            at = row * collection.width + begin[base + some][row] + spot
            w = [_hashes(_sums(flat, k), at, at + LENGTH).view(np.int64) for k in (0, 1)]
            own = names[base + some][row]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 2]), pa.array(own[:, 3]), pa.nulls(len(row), pa.binary()), *map(pa.array, w),
                                              pa.array(spot.astype(np.int32)), pa.array(~flags[base + some][row, spot])],
                                             names=["gram", "s1", "s2", "flags", "w1", "w2", "spot", "alone"])
        base += rows


def _removed(batches, texts: bool = True):
    """Each row less its repeated bytes."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        out = []
        for body, spans in zip(texts, batch.column("spans")):
            body = body.as_py() or b""
            cover = np.zeros(len(body) + 1, np.int64)
            for span in spans.as_py() or ():
                n = span["n"]
                bits = np.ones(n, np.int8) if span["whole"] else np.unpackbits(np.frombuffer(span["flags"], np.uint8))[:n].astype(np.int8)
                for k in span["more"] or ():
                    bits[k] = 1
                edge = np.flatnonzero(np.diff(np.concatenate(([0], bits, [0]))))
                np.add.at(cover, span["first"] + edge[::2], 1)
                np.add.at(cover, span["first"] + edge[1::2] + LENGTH - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes() if runs else body
            out.append((len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, text: str = "text", texts: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null without ``texts``)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grams = rows.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    known = spark.sparkContext.broadcast(bitmap(grams, "gram", BITS))
    found = stored(rows.mapInArrow(_occurrences(known), f"doc_id {kind}, text_key long, first long, n long, left long, gram long, s1 long, s2 long, body binary"), "segments")

    classes = found.groupBy("gram", "s1", "s2").agg(F.count("*").alias("copies"), F.first("left").alias("left"), F.first("n").alias("n"), F.first("body").alias("body"))
    classes = stored(classes, "classes")
    several = classes.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    several = stored(several, "several")
    count = several.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
    mixed = classes.join(several, "gram")
    parts = F.ceil(F.col("different") / HOT)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS))
    dealt = mixed.select("gram", F.pmod(F.xxhash64("s1", "s2"), parts).alias("part"), "s1", "s2", "n", "left", "body", (F.col("different") > HOT).cast("long").alias("hot"))
    sorted_ = stored(dealt.repartition(tasks, "gram", "part").mapInArrow(_sorted_columns, _FLAGS), "sorted")
    crossing = sorted_.where("w1 is not null").groupBy("gram", "w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("gram", "w1", "w2")
    more = (sorted_.where("w1 is not null and alone").join(crossing, ["gram", "w1", "w2"]).groupBy("gram", "s1", "s2").agg(F.collect_list("spot").alias("more")))
    flags = sorted_.where("flags is not null").select("gram", "s1", "s2", "flags").join(more, ["gram", "s1", "s2"], "left")
    empty = F.expr(f"unhex('{'00' * (-(-(LENGTH - GRAM + 1) // 8))}')")
    judged = (classes.select("gram", "s1", "s2", (F.col("copies") > 1).alias("whole")).join(flags, ["gram", "s1", "s2"], "left")
              .where((F.col("whole")) | (F.col("flags") != empty) | F.col("more").isNotNull()))
    judged = stored(judged, "judged")  # both sides of the next join are plain exchanges, so that a crowded class can be split there
    places = found.select("doc_id", "text_key", "first", "n", "gram", "s1", "s2").join(judged, ["gram", "s1", "s2"])
    spans = places.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(
        F.collect_set(F.struct(F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n"), "whole", F.when(~F.col("whole"), F.col("flags")).alias("flags"), "more")).alias("spans"))
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(lambda batches: _removed(batches, texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
