"""Exact percentiles by range refinement against numpy, with hot groups, far magnitudes and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import aggregates, orderstats

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]


def columns(kind, n=3000):
    rng = np.random.default_rng(5)
    return {"normal": rng.standard_normal(n), "ties": rng.integers(0, 5, n).astype(float), "far": 10.0 ** rng.uniform(-250, 250, n) * rng.choice([-1, 1], n),
            "close": 1.0 + rng.integers(0, 2000, n) * 2.0 ** -52, "one": np.full(n, 3.5), "zeros": np.append(np.zeros(n - 3), [1e-300, -1e-300, 1e300])}[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "far", "close", "one", "zeros"])
@pytest.mark.parametrize("leaf", [1, 64, 4096])
def test_global_percentiles(spark, kind, leaf):
    x = columns(kind)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = orderstats.percentiles(df, "x", FRACTIONS, leaf=leaf)
    assert got == pytest.approx([float(np.quantile(x, p)) for p in FRACTIONS], rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert orderstats.percentiles(df, "x", [0.5]) == [None]


@pytest.mark.parametrize("passes, leaf", [(2, 4096), (2, 8), (1, 50), (3, 1)])
def test_group_percentiles_with_a_hot_group(spark, passes, leaf):
    rng = np.random.default_rng(6)
    groups = {1: rng.standard_normal(4000) * 100, 2: np.array([7.0]), 3: rng.integers(0, 3, 500).astype(float), None: rng.uniform(0, 1, 50), 4: 10.0 ** rng.uniform(-30, 30, 300)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(9, None), (2, None)]
    counted = spark.createDataFrame(rows, "g long, v double").groupBy("g", "v").agg(F.count("*").alias("count"))
    out = orderstats.group_percentiles(counted, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, passes=passes, leaf=leaf)
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in out.collect()}
    assert got == {g: pytest.approx(tuple(float(np.quantile(x, p)) for p in (0.1, 0.5, 1.0)), rel=1e-12) for g, x in groups.items()}


def test_review_medians(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), bool(u), float(p)) for a, u, p in zip(np.minimum(rng.geometric(0.3, 4000), 9), rng.random(4000) < 0.7, rng.integers(-2, 900, 4000))]
    rows += [(20, False, 5.0), (21, True, 0.0), (22, None, 3.0)]
    got = {r["appid"]: r for r in aggregates.review_stats(spark.createDataFrame(rows, "appid long, voted_up boolean, playtime double")).collect()}
    for item in {a for a, *_ in rows}:
        own = [(u, p) for a, u, p in rows if a == item]
        played = [p for u, p in own if u and p > 0]
        r = got[item]
        assert (r["positive"], r["negative"], r["review_count"]) == (sum(u is True for u, _ in own), sum(u is False for u, _ in own), len(played))
        assert r["median_playtime"] == (pytest.approx(np.median(played)) if played else None)


def test_assembled_pieces_join_to_the_whole(spark):
    rng = np.random.default_rng(8)
    rows = [(1, int(i), "w" * int(rng.integers(0, 40)) + str(i)) for i in range(400)] + [(2, 1, "é"), (2, 0, ""), (2, 2, None), (3, 0, None), (4, 5, ""), (None, 1, "x"), (None, 0, "y")]
    df = spark.createDataFrame(rows, "k long, at long, t string")
    for piece in (7, 64, 100000):
        got = {}
        for r in sorted(aggregates.assembled_text(df, "k", ["at"], "t", " | ", piece).collect(), key=lambda r: r["part"]):
            assert len(r["text"]) <= piece
            got.setdefault(r["k"], []).append(r["text"])
        want = {k: " | ".join(t for _, t in sorted((at, t) for kk, at, t in rows if kk == k and t is not None)) for k in (1, 2, 4, None)}
        assert {k: "".join(v) for k, v in got.items()} == want
        assert all(len(x) == piece for v in got.values() for x in v[:-1])
