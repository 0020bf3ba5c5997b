import numpy as np
import pytest

from curatrix.llm import neighbours as nn


def brute(vectors, queries, k=10):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float64)
    out = {}
    for i, v in queries:
        keep = ids != i
        d = np.sqrt(((x[keep] - np.array(v, np.float64)) ** 2).sum(axis=1))
        order = np.lexsort((ids[keep], d))[:k]
        out[i] = list(zip(ids[keep][order].tolist(), d[order].tolist()))
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("group", [4096, 40])
def test_recall_on_given_vectors(spark, monkeypatch, group):
    monkeypatch.setattr(nn, "GROUP", group)
    df = nn.usable(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    rows = [(r.vec_id, r.vector) for r in df.collect()]
    queries = [r for r in rows if r[0] % 100 == 0]
    want, got = brute(rows, queries), found(nn.nearest(df, df.where("vec_id % 100 = 0")))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (x[1], x[0])) for q in want)


def test_odd_vectors_ties_repeats_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1),
            (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (9, [], 1), (100, [0.0, -3.0], 1)]
    df = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = found(nn.nearest(df, df.where("vec_id % 100 = 0")))
    assert [v for v, _ in got[0]] == [1, 2, 3, 100] and [v for v, _ in got[100]] == [0, 1, 2, 3]
    assert got[0][0][1] == 0.0 and got[0][2][1] == pytest.approx(5 ** 0.5)
    empty = df.where("false")
    assert nn.nearest(empty, empty).count() == 0 and nn.nearest(df, empty).count() == 0


def test_probe_order_is_by_success():
    inside = np.array([0.1, 0.7, 0.45])
    order = nn.probe_order(inside, 27)
    cost = [sum((inside[k] if d < 0 else 1 - inside[k]) ** 2 for k, d in moves) for moves in order]
    assert cost == pytest.approx(sorted(cost)) and len({frozenset(m) for m in order}) == len(order) == 27


def test_rows_of_one_id_are_one_candidate():
    """A vec_id that comes twice takes one place among the k, also where rows are cut to the nearest first."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((62, 4))
    ids = np.append(np.arange(61), 0)
    vectors[0] = vectors[61] = 0.01
    query = np.zeros(4)
    found, distance = nn._nearest(ids, vectors, query, -1, 10)
    best = {}
    for i, d in zip(ids, np.sqrt((vectors ** 2).sum(axis=1))):
        best[i] = min(d, best.get(i, np.inf))
    want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:10]
    assert found.tolist() == [i for i, _ in want] and np.allclose(distance, [d for _, d in want])
