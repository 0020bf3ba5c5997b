"""Packing of token sequences: best fit in bounded lots, then swap-based local search until bins empty.

A document's ids are the tokenizer's, then an end id. Longer ones than a sequence are cut into whole sequences and a rest; nothing else is cut. A
tokenizer that drops white space is asked once a task for each different unit (a run of letters, a digit, a run of other signs; a word with anything but
ASCII and Latin-1 letters whole), as no token of it crosses units; units are told apart by 64-bit hashes. Any other tokenizer gets whole texts.

Pieces that fill a sequence are done. The others are dealt by hash into lots of about ``LOT`` pieces. A lot is packed by best fit, longest first; then
its underfull bins exchange pieces: a piece moves, one goes for one, two for one or one for two, always from an emptier bin to a fuller one
and as much as fits, which raises the sum of squared fills, until emptiest bins empty or nothing more can be exchanged. Full bins are
final; the underfull ones of all lots are dealt anew and meet in the next round. Rounds end when ``IDLE`` of them in a row save no bin, when all that
is open was in one lot, or when the bound says that no fewer are possible (a bound from the counts by length, at most ``capacity`` numbers).

A null text is empty: its ids are the end id alone. Repeated rows are documents of their own; null doc_ids stay; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.storage import stored
from curatrix.llm.words import BLOCK, blocks, hashes_of, mix, word_bounds

CAPACITY = 4096
END = 1
LOT = 16384
SEEN = 1 << 20
SWEEPS = 400
FEW, NEAR = 8, 8
IDLE = 2
_EXACT = mix(np.arange(256, dtype=np.uint64) + np.uint64(3000))
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How a tokenizer that drops white space is recognised, whose tokens cross neither white space nor the edges of letter and digit runs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]

_GAP, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _GAP
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord("'"), ord("|")]] = _ODD
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block; starts, ends and oddness of its units; the units before each row (len + 1).

    A unit is a run of letters, a digit, or a run of other signs, in ASCII and Latin-1 letters; a word with anything else is one odd unit, left as it is.
    """
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return data, starts, ends, np.zeros(0, bool), rows
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    small = lead[data[lead + 1] <= 0x9E] + 1
    lower[small] += 32
    odds = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind == _ODD)))
    odd = odds[ends] > odds[starts]
    for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
        lower[a:b] = data[a:b]
        kind[a:b] = _ODD
    edge = np.ones(len(data), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[starts] = True
    edge &= kind != _GAP
    first = np.flatnonzero(edge)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = edge | (kind == _GAP)
    stop[offsets] = True
    after = np.flatnonzero(stop)
    return lower, first, after[np.searchsorted(after, first, side="right")], kind[first] == _ODD, np.searchsorted(first, offsets)


class _Words:
    """Ids of texts, unit by unit, for one task: each different unit is tokenized once; forgets all when it knows more than ``SEEN``."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer)
        parts = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_unit = normal == NORMAL and split[:1] == [SPLIT] and parts["post_processor"] is None
        if self.by_unit:
            self.spelt = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN}
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        tokenize, ids = self.tokenizer.model.tokenize, []
        for a, b, strange in zip(starts.tolist(), ends.tolist(), odd.tolist()):
            unit = raw[a:b].decode("utf-8")
            if strange:
                ids.append(self.tokenizer.encode(unit, add_special_tokens=False).ids)
            else:
                ids.append([t.id for t in tokenize(unit if len(unit) == b - a else unit.translate(self.spelt))])
        size = np.array([len(x) for x in ids], np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))
        hashes, begin, size = (np.concatenate(x) for x in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.begin, self.size = hashes[order], begin[order], size[order]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text as the tokenizer gives them, and the ids before each (len + 1)."""
        raw = data.tobytes()
        found = [self.tokenizer.encode(raw[a:b].decode("utf-8"), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in found], dtype=np.int64)))

    def _by_unit(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, starts, ends, odd, rows = _units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, first, inverse = np.unique(hashes_of(lower, starts, ends, _EXACT), return_index=True, return_inverse=True)
        fresh = ~self._places(hashes)[1]
        if fresh.any():
            if len(self.hashes) > SEEN:
                self._clear()
                fresh[:] = True
            at = first[fresh]
            self._learn(lower.tobytes(), hashes[fresh], starts[at], ends[at], odd[at])
        place = self._places(hashes)[0][inverse]
        size = self.size[place]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        return self.ids[np.arange(int(before[-1])) - np.repeat(before[:-1], size) + np.repeat(self.begin[place], size)], before[rows]

    def ids_of(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, each text closed by ``end``, and the ids before each text (len + 1)."""
        ids, counts = (self._by_unit if self.by_unit else self._whole)(data, offsets)
        bounds = counts + np.arange(len(counts))
        out = np.full(int(bounds[-1]), end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = ids
        return out, bounds


def _pieces(tokenizer: str, capacity: int, end: int, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        words = _Words(tokenizer)
        for batch in batches:
            for at, _, data, offsets in blocks(batch.column("text"), 4 * BLOCK):
                ids, bounds = words.ids_of(data, offsets, end)
                raw = ids.astype("<u4").tobytes()
                number = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(number)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[row] - start)
                first = bounds[row] + start
                crc = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())], np.int64)
                columns = [batch.column("doc_id").take(pa.array(at + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if tokens:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, first[-1] + length[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, with ``tokens`` also their ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end, tokens), _PIECE + (", ids array<int>" if tokens else ""))


def fewest(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``counts[s]`` pieces of length s can go below (for every t, pieces longer than capacity - t share with none of t or more)."""
    size = np.arange(len(counts))
    number, words = np.cumsum(counts), np.cumsum(counts * size)
    half, total = capacity // 2, words[-1]
    best = -(-int(total) // capacity)
    for t in range(half + 1):
        large = int(number[-1] - number[capacity - t])
        middle = int(number[capacity - t] - number[half])
        room = middle * capacity - int(words[capacity - t] - words[half])
        small = int(words[half] - (words[t - 1] if t else 0))
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


class _Lot:
    """Bins of a lot: members by bin, room by bin, and the bins of each room."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.members: list[list[int]] = []
        self.room: list[int] = []

    def best_fit(self) -> None:
        """Longest pieces first, each in the fullest bin that holds it."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for p in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[p]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
                self.members[b].append(p)
            else:
                b, room = len(self.members), self.capacity
                self.members.append([p])
                self.room.append(0)
            left = self.room[b] = room - size
            by_room[left].append(b)
            mask |= 1 << left

    def _options(self, b: int, empty: bool) -> list[list[int]]:
        """What may change places in bin b: nothing (if ``empty``), one piece, two pieces; of several of one total, one."""
        own = self.members[b]
        some = own if len(own) <= FEW else own[:FEW]
        found = {0: []} if empty else {}
        for i, p in enumerate(some):
            for q in some[i + 1:]:
                found[self.sizes[p] + self.sizes[q]] = [p, q]
        for p in own:
            found[self.sizes[p]] = [p]
        return list(found.values())

    def _index(self, bins: list[int]) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
        """All that bins may give back, in order of the weight that would then fill the bin exactly."""
        back = [(b, x) for b in bins for x in self._options(b, True)]
        fills = np.array([self.room[b] + sum(self.sizes[p] for p in x) for b, x in back], np.int64)
        order = np.argsort(fills, kind="stable")
        return fills[order], [back[i] for i in order]

    def _sweep(self, donor: int, fills: np.ndarray, back: list[tuple[int, list[int]]], stale: set[int]) -> bool:
        """Exchanges between the donor and fuller bins, each bin and piece once, those that fill most first; whether there was any."""
        found = []
        for x in self._options(donor, False):
            weight = sum(self.sizes[p] for p in x)
            at = int(np.searchsorted(fills, weight))
            for j in range(at, min(at + NEAR, len(back))):
                b, y = back[j]
                gain = weight - sum(self.sizes[p] for p in y)
                if b not in stale and gain > 0 and not len(x) == len(y) == 2:
                    found.append((gain, j, x))
        used: set[int] = set()
        changed = False
        for gain, j, x in sorted(found, key=lambda f: (-f[0], f[1])):
            b, y = back[j]
            if b in stale or used & set(x):
                continue
            stale.add(b)
            used |= set(x)
            self.members[donor] = [p for p in self.members[donor] if p not in x] + y
            self.members[b] = [p for p in self.members[b] if p not in y] + x
            self.room[donor] += gain
            self.room[b] -= gain
            changed = True
        return changed

    def local_search(self, bound: int, sweeps: int) -> None:
        """The emptiest bin gives to fuller ones until no exchange is left, then the next one, and again from the emptiest, down to ``bound`` bins."""
        bins, stuck = len(self.room), set()
        while bins > bound and sweeps > 0:
            open_ = sorted((b for b in range(len(self.room)) if self.room[b] and self.members[b]), key=lambda b: (self.room[b], b))
            donor = next((b for b in reversed(open_) if b not in stuck), None)
            fuller = open_[:open_.index(donor)] if donor is not None else []
            if not fuller:
                break
            fills, back = self._index(fuller)
            stale: set[int] = set()
            while self.members[donor] and sweeps > 0:
                sweeps -= 1
                if not self._sweep(donor, fills, back, stale) or len(stale) > len(fuller) // 4:
                    break
            if stale:
                stuck.clear()
            else:
                stuck.add(donor)
            bins -= not self.members[donor]


def pack(sizes: np.ndarray, capacity: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece of a lot its bin, its place there, and whether that bin is full."""
    lot = _Lot(sizes, capacity)
    lot.best_fit()
    bound = fewest(np.bincount(sizes, minlength=capacity + 1), capacity)
    if len(lot.members) > bound:
        lot.local_search(bound, sweeps)
    bins, places, full = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for b, members in enumerate(lot.members):
        at = 0
        for p in sorted(members):
            bins[p], places[p], full[p] = b, at, lot.room[b] == 0
            at += lot.sizes[p]
    return bins, places, full.astype(bool)


def _packed(capacity: int, sweeps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("unit", ignore_index=True)
        bins, places, full = pack(lot["length"].to_numpy(np.int64), capacity, sweeps)
        first = pd.Series(lot["unit"].to_numpy()).groupby(bins).transform("min")
        return lot.drop(columns="lot").assign(sequence_id=first.to_numpy(), offset=places, full=full)

    return run


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", lot: int = LOT, sweeps: int = SWEEPS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A sequence is named by the number of its first piece."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "unit"]
    pieces = stored(token_pieces(docs, tokenizer, capacity, end, text).withColumn("unit", F.monotonically_increasing_id()), "pieces")
    done = [pieces.where(F.col("length") == capacity).select(*columns, F.col("unit").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = pieces.where(F.col("length") < capacity)
    shape = f"{_PIECE}, unit long, sequence_id long, offset long, full boolean"
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in open_.groupBy("length").count().collect():
        counts[size] = n
    bound, least, full, turn, idle = fewest(counts, capacity), None, 0, 0, 0
    while True:
        n = open_.count()
        if not n:
            break
        lots = -(-n // lot)
        dealt = open_.select(*columns, F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(lots)).alias("lot"))
        out = stored(dealt.repartition(min(lots, 4096), "lot").groupBy("lot").applyInPandas(_packed(capacity, sweeps), shape), "packed")
        states = {r["full"]: r["n"] for r in out.groupBy("full").agg(F.count_distinct("sequence_id").alias("n")).collect()}
        full += states.get(True, 0)
        bins = full + states.get(False, 0)
        idle = idle + 1 if least is not None and bins >= least else 0
        if lots == 1 or bins <= bound or idle == IDLE:
            done.append(out.drop("full"))
            break
        least, turn = bins if least is None else min(bins, least), turn + 1
        done.append(out.where("full").drop("full"))
        open_ = out.where("not full")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("unit")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves; documents that share a doc_id and a piece's ids may stand for each other."""
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    by_place = [F.xxhash64(*place).alias("k"), *place]

    def numbered(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("copy", F.row_number().over(Window.partitionBy("k", *place).orderBy(order)))

    where = numbered(packed(docs, tokenizer, capacity, end, text).select(*by_place, "sequence_id", "offset"), "sequence_id")
    ids = numbered(token_pieces(docs, tokenizer, capacity, end, text, tokens=True).select(*by_place, "ids"), "k")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("k", *place, "copy")]
    joined = where.alias("a").join(ids.alias("b"), same).select("sequence_id", "offset", "a.doc_id", "ids")
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
