import random
from types import SimpleNamespace

import numpy as np
import pytest

from curatrix.llm import graph, neardup
from curatrix.llm.graph import components

from .brute import near_components

SCHEMA = "doc_id long, text string, n_shingles int, component string"


def family(seed, size, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(words)] = f"x{rng.randrange(99)}"
        out.append(" ".join(text))
    return out


def fixture():
    texts = [None, "", "  \n", "one two", "One TWO", "one two three four five", "a " * 3000]
    for seed, size in enumerate((2, 3, 8, 60)):
        texts += family(seed, size)
    texts += [texts[-1]] * 3
    return [(i, t, 7, "clash") for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [512, 7])
def test_same_components_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = fixture()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = near_components([(i, t) for i, t, *_ in rows])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_tiles_alone_find_every_link(spark):
    """With no star links at all, the tiles of a bucket connect the same documents."""
    import pandas as pd
    import pyarrow as pa
    rows = [(i, t) for i, t in enumerate(family(3, 40))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text_key": [0] * len(rows), "text": [t for _, t in rows]})
    features = next(neardup._features([batch])).to_pandas()
    everything = SimpleNamespace(value=np.full(16, 2 ** 64 - 1, np.uint64))
    sets = next(neardup._full_sets(everything)([batch])).to_pandas()
    frame = pd.DataFrame({"rep": features.doc_id, "component": features.doc_id, "block": 0, "kind": 1, "band": 5, "i": 0, "j": 0, "signature": features.signature, "items": sets["items"]})
    root = {i: i for i, _ in rows}
    for a, b in neardup._tile(75)(frame).itertuples(index=False):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    assert root == {i: c for i, (_, c) in near_components(rows).items()}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 4, 0, True), (1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_texts_that_share_a_doc_id(spark):
    """Each text of a repeated doc_id keeps its own links."""
    a, b = ([x, x + " end"] for x in (family(21, 1)[0], family(22, 1)[0]))
    rows = [(5, a[0]), (5, b[0]), (3, a[1]), (9, b[1]), (7, "alone in the world of many words")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (9, 5, False)]


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_components_of_a_chain(spark, monkeypatch, few):
    """Small tables in one task and rounds of joins agree."""
    monkeypatch.setattr(graph, "FEW", few)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (61, 60), (None, 3), (70, 75), (75, 72), (72, 71)], "a long, b long")
    got = {r.node: r.component for r in components(chain, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 60: 60, 61: 60, **dict.fromkeys((70, 71, 72, 75), 70)}
    assert components(chain.where("false"), "a", "b").count() == 0
