"""Steps of op3 and op5 in cheaper forms: sliding minima, distinct values, tiles, runs of bytes; each against a plain form."""

import numpy as np
import pandas as pd
import pytest

from curatrix.llm import bitmap, neardup, paragraphs
from curatrix.llm.words import distinct_by_row


@pytest.mark.parametrize("width", [1, 2, 27, 41])
def test_least_is_the_first_minimum_of_every_window(width):
    values = np.random.default_rng(width).integers(0, 9, 200).astype(np.uint64)
    want = np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1) + np.arange(200 - width + 1)
    assert np.array_equal(paragraphs._least(values, width), want)


@pytest.mark.parametrize("rows", [5, 70_000])
def test_distinct_values_of_few_and_of_many_rows(rows):
    rng = np.random.default_rng(3)
    size = rng.integers(0, 4, rows)
    cut = np.concatenate(([0], np.cumsum(size)))
    values = rng.integers(0, 3, int(cut[-1])).astype(np.uint64)
    got, bounds = distinct_by_row(values, cut)
    for i in [*range(5), rows - 1]:
        assert got[bounds[i]:bounds[i + 1]].tolist() == sorted(set(values[cut[i]:cut[i + 1]].tolist()))


def plain_links(rows, percent, sure):
    """Links of the tiles by comparing all pairs in order."""
    root, found = {}, []

    def find(x):
        return x if root.setdefault(x, x) == x else find(root[x])

    tiles = {}
    for r in sorted({(*r[:5], r[5], r[6], i): r for i, r in rows}.values(), key=lambda r: r[:5]):
        if r[4] not in [x[4] for x in tiles.setdefault(r[:4], [])]:
            tiles[r[:4]].append(r)
    for tile in tiles.values():
        crossing = len({r[5] for r in tile}) > 1
        for n, a in enumerate(tile):
            for b in tile[n + 1:]:
                if crossing and a[5] == b[5] or not crossing and a[1] == 0 or find(a[6]) == find(b[6]):
                    continue
                both, either = len(a[8] & b[8]), len(a[8] | b[8])
                if np.mean(a[7] == b[7]) >= sure and 100 * both >= percent * either:
                    x, y = find(a[6]), find(b[6])
                    root[max(x, y)] = min(x, y)
                    found.append((a[4], b[4]))
    return found


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_tiles_give_the_links_of_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(neardup, "TILE_PAIRS", pairs)
    rng = np.random.default_rng(7)
    sets = {k: frozenset(rng.choice(12, rng.integers(6, 12), replace=False).tolist()) for k in range(40)}
    marks = {k: rng.integers(0, 2, 8).astype(np.uint32) for k in sets}
    homes = {k: int(rng.integers(0, k + 1)) if k % 3 == 0 else k for k in sets}
    rows = []
    for _ in range(400):
        k, kind = int(rng.integers(0, 40)), int(rng.integers(0, 2))
        rows.append((int(rng.integers(0, 9)), kind, int(rng.integers(0, 2)), 0, k, k % 2, homes[k], marks[k], sets[k]))
    frame = pd.DataFrame([(*r[:7], r[7].tobytes(), np.array(sorted(r[8]), np.int64)) for r in rows], columns=["band", "kind", "i", "j", "rep", "block", "component", "signature", "items"])
    want = plain_links(list(enumerate(rows)), 75, .4)
    assert want and list(neardup._tile(75, .4)(frame).itertuples(index=False, name=None)) == want


def test_runs_and_windows_need_no_sorted_sums_and_one_exchange(spark, monkeypatch):
    plans, plain = {}, paragraphs.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(paragraphs, "stored", watched)
    words = [f"w{i}" for i in range(150)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x y z " + " ".join(words[10:80])), (3, "p q " + " ".join(words[40:150]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert got[1] == 0 and got[2] > 0 and got[3] > 0
    assert "SortAggregate" not in plans["runs"] and "SortMergeJoin" not in plans["windows"]
    assert plans["windows"].count("Exchange hashpartitioning") == 1


def test_a_bitmap_does_not_come_partition_by_partition(spark, monkeypatch):
    keys = spark.createDataFrame([(1,), (64,), (70_000,), (-1,)], "k long")
    monkeypatch.setattr(type(keys), "toLocalIterator", lambda *_: pytest.fail("a job for every partition"))
    found = bitmap.bitmap(keys, "k", 1 << 20)
    assert bitmap.contains(found, np.array([1, 64, 70_000, (1 << 64) - 1, 2, 65], np.uint64)).tolist() == [True] * 4 + [False] * 2
