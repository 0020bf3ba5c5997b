import hashlib
import random

import numpy as np
import pytest

from curatrix.llm import suffixes


def brute(texts, length=200):
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        gone = gone[:-1] if len(b) else np.zeros(0, bool)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def fixture(seed=2):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    hot, other = prose(260), prose(400)
    texts = [None, "", "short", prose(199), "x" * 199, "y" * 200, "z" * 201, "Annt " * 300, hot, hot, "ab" * 500 + hot[:150]]
    for i in range(60):
        near = list(other)
        near[rng.randrange(400)] = "#"
        texts += [prose(rng.randrange(300)) + hot + prose(rng.randrange(300)), "".join(near), prose(rng.randrange(500))]
    return texts + [texts[20]] * 3 + [hot + hot]


@pytest.mark.parametrize("hot,rows,chunk", [(4096, 40000, 1 << 20), (5, 30, 300)])
def test_same_as_brute_force(spark, monkeypatch, hot, rows, chunk):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "ROWS", rows)
    texts = fixture()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, gram string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(df).collect()}
    want = brute(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_long_rows_are_cut_without_loss(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    text = "".join(random.Random(1).choice("abc de") for _ in range(4000))
    starts = set()
    for _, data, offsets, shift in suffixes._chunks(pa.array(["abc" * 20, text, "x" * 450])):
        row, first, n, spot, gram, _ = suffixes.segments(data, offsets)
        if len(data) and shift + len(data) > 0 and len(offsets) == 2 and data[:3].tobytes() != b"xxx":
            for a, m in zip(first, n):
                starts |= set(range(shift + a, shift + a + m))
    assert starts == set(range(4000 - 199))


def test_repeats_nulls_and_empty_table(spark):
    body = "".join(random.Random(8).choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, body), (1, body), (None, body[:150]), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.deduplicated(df).collect())
    assert got == [(0, 0, 0, 0), (0, 150, 0, 0), (1, 300, 300, 1), (1, 300, 300, 1)]
    assert suffixes.deduplicated(df.where("false")).count() == 0
