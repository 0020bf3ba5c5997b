"""The lists of all users come from one pass over the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import pairs, taste


def tables(spark, users=6, items=40):
    m = np.random.default_rng(1).normal(size=(items, 4))
    table = spark.createDataFrame([(i, [float(x) for x in v], i / items, [0.1, 0.2], True, i % 2 == 0, i % 3 == 0, ["a"]) for i, v in enumerate(m)],
                                  "appid long, vec array<double>, x double, quality_steps array<double>, recommendable boolean, is_free boolean, is_upcoming boolean, tag_set array<string>")
    known = spark.createDataFrame([(u, (u + i) % items, 9.0, 0.5, 2.0) for u in range(users) for i in range(3)], "user_id long, appid long, rating double, residual double, power double")
    facts = spark.createDataFrame([(u, 5.0, [0.5], 0.1, 0, [u], [], ["a"]) for u in range(users)],
                                  "user_id long, level double, betas array<double>, quality_beta double, step int, owned array<long>, backlog array<long>, tags array<string>")
    return table, known.join(table.select("appid", "vec"), "appid"), facts


def test_pairs_are_gone_through_once(spark):
    table, known, facts = tables(spark)
    out = taste.profile_lists(table, known, facts, ["x"], [("vec", 1.0)], None)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FlatMapCoGroupsInPandas") == 1
    assert out.filter("section = 'neighbourhood'").groupBy("user_id", "label").agg(F.max("rank").alias("n"), F.count("*").alias("c")).where("n <> 10 or c <> 10").count() == 0


def test_pieces_are_many_times_as_long_as_the_lists(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 100)
    items = spark.createDataFrame([(i, [1.0]) for i in range(2000)], "appid long, vec array<double>")
    rated = spark.createDataFrame([(u, u % 9, 7.0) for u in range(1000)], "user_id long, appid long, rating double")
    left, right = pairs._rated_blocks(items, items.filter("appid < 9"), rated, None, ["rating"], "appid", 100)
    assert [left.select(c).distinct().count() for c in ("_piece", "_block")] == [1, 8]
    assert right.agg(F.sum(F.size("_user_ids"))).first()[0] == 1000


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_best_rows_of_lines_equal_a_sort(monkeypatch, held):
    monkeypatch.setattr(pairs, "HELD_ROWS", held)
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(7, 60)), 1)  # ties
    scores[0], scores[1, ::2], scores[2, 5], scores[3, :58] = -np.inf, np.nan, np.inf, -np.inf
    ids, best = rng.permutation(60), pairs._Best({"s": 4, "t": 9})
    for at in range(0, 60, 20):
        for section in "st":
            best.add(0, section, np.arange(7), np.array(list("abcdefg"), object), ids[at:at + 20], scores[:, at:at + 20], 2 * scores[:, at:at + 20])
    got = best.told()
    for section, k in (("s", 4), ("t", 9)):
        for u in range(7):
            want = sorted(((-x, a) for x, a in zip(scores[u], ids) if np.isfinite(x)))[:k]
            mine = got[(got["section"] == section) & (got["user_id"] == u)]
            assert [(-s, a) for s, a in zip(mine["score"], mine["appid"])] == want and list(mine["value"]) == [-2 * s for s, _ in want] and set(mine["label"]) <= {"abcdefg"[u]}
