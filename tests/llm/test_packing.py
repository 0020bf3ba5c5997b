"""Packing: ids against the tokenizer itself, gapless sequences, the number of bins against a bound and exhaustive search."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from curatrix.llm import packing
from curatrix.llm.words import blocks

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", "×", "ß", "'s", "'", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "٣", "²", " ", "\t", "\x0b", "\x1c", " ", "́", "İ", "ﬁ",
         "中文", "😀", "!", "...", "\x00", "\x7f", " ", "the", "don't", "Ñandu", "À", "ª", "�"]
SHAPE = "doc_id long, text string, length string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("seen", [1 << 20, 3])
def test_ids_are_the_tokenizers(name, seen, monkeypatch):
    monkeypatch.setattr(packing, "SEEN", seen)
    pick = random.Random(3)
    texts = [None, "", " ", "x" * 3000] + ["".join(pick.choice(PARTS) for _ in range(pick.randint(1, 12))) for _ in range(800)]
    whole, words = Tokenizer.from_file(public_tokenizers.path(name)), packing._Words(public_tokenizers.path(name))
    for at, to, data, offsets in blocks(pa.array(texts), 2000):
        ids, bounds = words.ids_of(data, offsets, 1)
        for i in range(at, to):
            assert ids[bounds[i - at]:bounds[i - at + 1]].tolist() == whole.encode(texts[i] or "", add_special_tokens=False).ids + [1]


def brute(sizes, capacity):
    best = len(sizes)
    for places in product(range(min(best, 5)), repeat=len(sizes)):
        fill = np.bincount(places, weights=sizes)
        if fill.max() <= capacity:
            best = min(best, int((fill > 0).sum()))
    return best


def test_small_lots_are_packed_best():
    pick = random.Random(5)
    for _ in range(25):
        sizes = np.array([pick.randint(1, 10) for _ in range(pick.randint(1, 7))])
        want = brute(sizes, 12)
        bins, places, full = packing.pack(sizes, 12)
        assert packing.fewest(np.bincount(sizes, minlength=13), 12) <= want <= len(set(bins)) <= want + (want > 2)
        for b in set(bins):
            own = np.flatnonzero(bins == b)
            assert sizes[own].sum() <= 12 and (full[own] == (sizes[own].sum() == 12)).all()
            assert places[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()


@pytest.mark.parametrize("seed", [1, 3, 7, 29, 37])
def test_exchanges_empty_bins_that_best_fit_leaves(seed):
    sizes = np.random.default_rng(seed).integers(8, 60, 80)
    lot, bound = packing._Lot(sizes, 100), packing.fewest(np.bincount(sizes, minlength=101), 100)
    lot.best_fit()
    before, squares = len(lot.members), sum((100 - r) ** 2 for r in lot.room)
    lot.local_search(bound, packing.SWEEPS)
    assert sum((100 - r) ** 2 for r in lot.room) > squares
    assert sum(1 for m in lot.members if m) == bound < before
    assert sorted(p for m in lot.members for p in m) == list(range(80))
    assert all(sum(sizes[m]) == 100 - r for m, r in zip(lot.members, lot.room))


def test_documents_in_sequences(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice(["one", "two", "threeish", "4!"]) for _ in range(pick.randint(0, 40))), "x") for i in range(120)]
    rows += [(None, "no id", "x"), (7, "a second seven", "x"), (8, None, "x"), (9, "", "x"), (10, "long " * 200, "x"), (10, "long " * 200, "x")]
    docs = spark.createDataFrame(rows, SHAPE)
    out = packing.packed(docs, PATH, capacity=32, lot=16).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(-1 if doc_id is None else doc_id, p, 32 * p, len(ids[32 * p:32 * p + 32]), zlib.crc32(ids[32 * p:32 * p + 32].tobytes())) for p in range(-(-len(ids) // 32))]
    got = out.assign(doc_id=out["doc_id"].fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    total = 0
    for _, one in out.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == (one["length"].cumsum() - one["length"]).tolist() and one["length"].sum() <= 32
        total += 1
    sizes = np.array([w[3] for w in want])
    assert total <= packing.fewest(np.bincount(sizes, minlength=33), 32) + 4
    again = packing.packed(docs, PATH, capacity=32, lot=10 ** 6)
    assert again.select("sequence_id").distinct().count() <= total


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", None), (1, "a b c d e f", None), (2, "g", None), (None, None, None)], SHAPE)
    out = packing.sequences(docs, PATH, capacity=5).collect()
    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in ("a b c d e f", "a b c d e f", "g", "")]
    assert sorted(i for r in out for i in r["ids"]) == sorted(i for w in want for i in w) and max(len(r["ids"]) for r in out) <= 5
    assert len(out) == 4


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SHAPE), PATH).count() == 0
