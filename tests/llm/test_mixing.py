import pytest
from pyspark.sql import functions as F

from curatrix.llm.mixing import mixed, mixed_texts, targets


def shared_out(sizes, weights, most=3):
    """Repeated resharing, as the words say it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            goal |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            goal[s] = float(most * sizes[s])
            free.discard(s)
        left -= sum(goal[s] for s in over)
    return goal


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 50, "c": 1000, None: 70, "Z": 0, "é": 400}, {"a": 10}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(shared_out(sizes, (1, 2, 3)), abs=1e-5)


def test_mix_reaches_targets_with_hot_source_and_repeats(spark):
    rows = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(600)] + [(7, "a b c", "s1", 1)] * 5 + [(None, "x y", None, 1), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    quality = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(600)] + [(3, 4.0), (None, 1.0)], "doc_id long, quality double")
    out = mixed(df, quality).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixed(df, quality).collect()))
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for rs in by.values():
        assert rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 6
        epochs = round(rs[0].target) // max(1, rs[0].source_size)
        assert all(r.taken >= epochs * r["size"] for r in rs)
        part = sorted((r.key, r.doc_id or 0) for r in rs if r.taken > epochs * r["size"])
        rest = sorted((r.key, r.doc_id or 0) for r in rs if r.taken == epochs * r["size"] and r["size"])
        assert not part or not rest or part[-1] <= rest[0]
    assert mixed(df.where("false")).count() == 0
    texts = mixed_texts(df, quality=quality)
    assert texts.columns == [*df.columns, "taken"] and texts.count() == sum(r.taken > 0 for r in out)


def test_good_documents_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 3600, "a").otherwise("b").alias("source"))
    quality = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.5).alias("quality"))
    got = mixed(df, quality).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("taken").alias("t")).collect()
    share = {r.odd: r.t for r in got}
    assert share[0] > share[1]


def test_rows_without_ids_spread_over_keys(spark):
    """Rows without an id are drawn by their text: as many keys as texts, equal texts alike."""
    rows = [(None, f"word{i} of many", "a") for i in range(300)] + [(None, "same text", "a")] * 20 + [(None, None, "b"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed(df, spark.createDataFrame([(None, 9.0)], "doc_id long, quality double"), weights=(1.0,), share=0.5).collect()
    assert len(out) == len(rows) and len({r.key for r in out}) == 303
    assert len({r.taken for r in out if r["size"] == 2}) == 1
    assert abs(sum(r.taken for r in out if r.source == "a") - next(r.target for r in out if r.source == "a")) <= 20 + 3
