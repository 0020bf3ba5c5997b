"""The kernel over an item's playtimes holds few sorts and sums in one task, and gives brute-force sums however items are cut in chunks."""

import math
import re

import pytest
from pyspark.sql import functions as F

from curatrix.operators import playtime

HOLDING = re.compile(r"(Sort|HashAggregate|ObjectHashAggregate|SortAggregate)\b")


def most_in_a_stage(df) -> int:
    """The most operators with buffers between two exchanges of the plan."""
    counts, path = {}, []
    for number, line in enumerate(df._jdf.queryExecution().executedPlan().toString().splitlines(), 1):
        found = re.search(r"[A-Za-z]\w*", line)
        if not found:
            continue
        while path and path[-1][0] >= found.start():
            path.pop()
        stage = path[-1][1] if path else 0
        if HOLDING.match(found[0]):
            counts[stage] = counts.get(stage, 0) + 1
        path.append((found.start(), number if found[0] == "Exchange" else stage))
    return max(counts.values())


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_stage_holds_many_sorts(no_broadcast):
    spark = no_broadcast
    library = spark.createDataFrame([(1, 1, 5.0, None), (2, 1, 0.0, True)], "user_id long, appid long, playtime double, user_voted_up boolean")
    items = spark.createDataFrame([(1, 3, 1)], "appid long, positive long, negative long")
    reviews = spark.createDataFrame([(1, 5.0, True), (1, 7.0, False)], "appid long, playtime double, voted_up boolean")
    labels = playtime.soft_labels(library, items, reviews, F.lit(.65))
    assert most_in_a_stage(labels) <= 6
    assert most_in_a_stage(playtime.vote_probability(reviews.select("appid", F.col("playtime").alias("x")), playtime.vote_histogram(reviews), F.lit(.65))) <= 6
    assert labels.count() == 2


@pytest.mark.parametrize("chunk", [2, 2048])
def test_sums_of_chunks_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(playtime, "CHUNK", chunk)
    known = [(1, float(x), float(1 + x % 3), float(x % 2)) for x in range(1, 8)] + [(2, 4.0, 2.0, 1.0), (None, 4.0, 1.0, 1.0), (4, 1.0, 1.0, 0.0)]
    asked = [(1, 1.5), (1, 3.0), (1, 3.0), (1, 40.0), (2, 9.0), (3, 2.0), (None, 4.0)]
    sums = playtime.kernel_sums(spark.createDataFrame(asked, "appid long, x double"), spark.createDataFrame(known, "appid long, x double, n double, up double"), [.5, 2.0])
    got = {(r["appid"], r["x"]): [*r["total"], *r["positive"]] for r in sums.collect()}
    want = {(a, x): [sum(row[i] * math.exp(-.5 * ((math.log(row[1]) - math.log(x)) / w) ** 2) for row in known if row[0] == a) for i in (2, 3) for w in (.5, 2.0)]
            for a, x in asked if a in (1, 2)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


@pytest.mark.parametrize("chunk", [2, 2048])
def test_likelihoods_do_not_depend_on_chunks(spark, monkeypatch, chunk):
    known = [(a, float(x), float(1 + x % 3), float(x % 2)) for a, most in ((1, 9), (2, 3), (3, 2)) for x in range(1, most)] + [(4, 1.0, 1.0, 0.0)]
    histogram = spark.createDataFrame(known, "appid long, x double, n double, up double")
    want = {}
    for w in (.5, 2.0):
        ll = 0.0
        for a, x, n, up in known:
            own = [r for r in known if r[0] == a]
            if sum(r[2] for r in own) < 2:
                continue
            t, p = (sum(r[i] * math.exp(-.5 * ((math.log(r[1]) - math.log(x)) / w) ** 2) for r in own) for i in (2, 3))
            clip = lambda v: min(max(v, 1e-12), 1 - 1e-12)
            ll += up * math.log(clip((p - 1 + 1.5 * .65) / (t - 1 + 1.5))) + (n - up) * math.log1p(-clip((p + 1.5 * .65) / (t - 1 + 1.5)))
        want[w] = ll
    monkeypatch.setattr(playtime, "CHUNK", chunk)
    got = {r["width"]: r["log_likelihood"] for r in playtime.likelihood_grid(histogram, .65, [.5, 2.0], [1.5]).collect()}
    assert got == pytest.approx(want, rel=1e-6)
