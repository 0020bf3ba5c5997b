"""Steps that several queries share are worked out once, and on all tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from curatrix.checks import extraction, scalars
from curatrix.checks.standins import Tables
from curatrix.operators import explain, matrix, pairs
from curatrix.session import parallelism


def test_store_pages_are_dealt_over_all_tasks(spark, tmp_path):
    rows = [(i, "ivory", "BRAND", "TIN", i % 50, 900.0) for i in range(1, 400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = extraction.store_pages(Tables(spark, str(tmp_path))).select("appid", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["appid"] for r in found) == list(range(1, 400))
    assert len({r["p"] for r in found}) == parallelism(spark.range(1)) > 1


def test_covariance_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    data = [[1.0, 2.0], [2.0, 1.0], [4.0, 7.0]]

    @F.udf("array<double>")
    def counted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame([(v,) for v in data], "v array<double>").select(counted("v").alias("v"))
    got = {(r["i"], r["j"]): r["r"] for r in matrix.correlations(df, "v", 2).collect()}
    assert seen.value == len(data)
    assert np.isclose(got[0, 1], np.corrcoef(np.array(data).T)[0, 1])


def test_centroids_of_long_short_and_null_vectors(spark):
    long = [float(i) for i in range(130)]
    rows = [("a", long), ("a", [2.0, None]), ("a", None), ("b", [1.0, 3.0]), ("b", [3.0]), ("b", [None, 5.0]), ("c", []), (None, [7.0]), ("d", [None, 1.0])]
    got = {r["k"]: r["vec"] for r in pairs.centroids(spark.createDataFrame(rows, "k string, vec array<double>"), "k").collect()}
    assert got == {"a": [1.0, *long[1:]], "b": [2.0, 4.0], None: [7.0], "d": [None, 1.0]}


def test_motivation_scores_reads_users_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(v):
        seen.add(1)
        return v

    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "user_id long, v array<double>").select("user_id", counted("v").alias("vec"))
    motives = spark.createDataFrame([("m", [1.0, 0.0])], "motive string, vec array<double>")
    got = {r["user_id"]: round(r["score"], 6) for r in explain.motivation_scores(users, motives, {"vec": 2.0}).collect()}
    assert got == {1: 2.0, 2: round(2 / np.sqrt(2), 6)}
    assert seen.value == 2


def test_neighbours_over_many_tiles_equal_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (60, 3)).astype(float)
    vectors = base[rng.integers(0, 60, 300)]  # many copies, so many ties
    df = spark.createDataFrame(pd.DataFrame({"appid": np.arange(300), "vec": [list(map(float, v)) for v in vectors]}))
    wanted = {s: sorted((-float(vectors[s] @ vectors[c]), c) for c in range(300) if c != s)[:5] for s in range(300)}
    for rows in (None, 16):
        got: dict[int, list] = {}
        for r in sorted(pairs.neighbours(df, df, 5, "dot", rows=rows).collect(), key=lambda r: (r["seed"], r["rank"])):
            got.setdefault(r["seed"], []).append((-r["similarity"], r["appid"]))
        assert got == wanted


def test_neighbours_pass_on_k_rows_a_seed_and_piece(spark):
    df = spark.range(3000).select(F.col("id").alias("appid"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("vec"))
    pieces, blocks = pairs._few_pieces(df, df, None)
    assert pieces * blocks >= 2 and pieces <= 3 and blocks <= 3


def test_busiest_user_and_kept_views_are_worked_out_once(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 10, 0.01, 2.0), (2, 10, 0.02, 3.0), (3, 11, 0.03, 4.0), (3, 10, 0.05, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    mine = scalars.busiest_user(t)
    assert mine is scalars.busiest_user(t) and mine.storageLevel.useMemory
    assert sorted(map(tuple, mine.collect())) == [(7, 10, 5, 3.0), (7, 11, 3, 4.0)]
    t.keep("ratings")
    assert t.ratings.storageLevel.useMemory and t.ratings.count() == 3
