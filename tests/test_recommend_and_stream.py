"""Scores of the recommendation, the seed kernel's behaviour, and streams over several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curatrix.operators import kernel as K
from curatrix.plans import recommend as R
from curatrix.streaming import ingest


def kernel_items(spark):
    rows = [  # id, name, verbs, vec, topics, tags, difficulty, tone
        (1, "Mind Palace", [1.0, 1.0, 0.0], [1.0, 0.0], [.7, .3], ["Detective", "2D"], 0.0, 0.0),
        (2, "Quiet Clues", [1.0, .8, 0.0], [.9, .1], [.7, .3], ["Detective", "3D"], 0.0, 0.0),
        (3, "Quiet Clues Hard", [1.0, .8, 0.0], [.9, .1], [.7, .3], ["Detective", "3D"], 6.0, 0.0),
        (4, "Palace Tycoon", [0.0, .1, 1.0], [.1, 1.0], [.1, .9], ["Management"], 0.0, 0.0),
        (5, "Plain Thing", [0.0, 0.0, 1.0], [-1.0, .2], [.1, .9], ["Casual"], 0.0, 0.0)]
    df = spark.createDataFrame(rows, "appid long, name string, verbs array<double>, vec array<double>, topics array<double>, tag_set array<string>, difficulty_z double, tone_z double")
    tax = K.Taxonomy()
    soul = df.select("appid", F.explode("tag_set").alias("tag"))
    groups = K.item_groups(soul, tax).groupBy("appid").agg(F.collect_set("group").alias("groups"))
    return df.join(groups, "appid"), soul, tax


def test_kernel_prefers_likeness_and_equal_difficulty(spark):
    items, soul, tax = kernel_items(spark)
    seed = K.merge_seed(items, [1], soul, tax)
    k = {r["appid"]: r["kernel"] for r in K.seed_kernel(items, seed, tax).collect()}
    assert k[1] > k[2] > k[3] > k[5] and k[4] < .05


def test_unknown_seed_is_no_seed(spark):
    items, soul, tax = kernel_items(spark)
    assert K.merge_seed(items, [99], soul, tax) is None


def test_title_hijack(spark):
    df = spark.createDataFrame([("Palace Tycoon",), ("Mind Palace Remake",), ("Other",)], "name string")
    assert [r[0] for r in df.select(K.title_hijack(["Mind Palace"])).collect()] == [True, False, False]


@pytest.mark.parametrize(("zs", "ws", "score"), [((1.0, 0.0), (1.0, 0.0), 6.0), ((10.0, 20.0), (1.0, 1.0), 35.0), ((3.0, 4.0), (0.0, 0.0), 5.0)])
def test_manual_score(spark, zs, ws, score):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, zs[0], zs[1], 0.0, 0.0, 0.0, 0.0)],
                                "semantic_sim double, tag_sim double, topic_signal double, z_quality double, z_date double, z_pop double, z_length double, z_difficulty double, z_price double")
    assert row.select(R.manual_score(R.Request(quality=ws[0], age=ws[1]), False)).first()[0] == pytest.approx(score)


def test_subversion_rules(spark):
    df = spark.createDataFrame([(["Dating Sim", "Psychological Horror"],), (["Cute"],), (["Psychological Horror"],)], "tag_set array<string>")
    assert [r[0] for r in df.select(K.subversion_chance()).collect()] == [.95, 0.0, 0.0]
    assert [r[0] for r in df.select(K.subversion_tier()).collect()] == [3, 0, 1]


UPDATE_SCHEMA = "user_id long, appid long, actual_rating double, ignore boolean, status string, notes string, updated_at timestamp, delete boolean, seq long"


def test_status_stream_over_batches_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    parts = [[(1, 10, 5.0, False, "played", "first", day, False, 1), (1, 11, 4.0, False, "backlog", None, day, False, 2)],
             [(1, 10, 7.0, False, None, None, day, False, 3), (1, 11, None, False, None, None, day, True, 4)],
             [(1, 11, 9.0, False, None, "again", day, False, 5), (2, 10, 1.0, True, "ignored", None, day, False, 6)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, UPDATE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
    everything = spark.read.schema(UPDATE_SCHEMA).parquet(str(tmp_path / "updates"))
    stream = ingest.file_stream(spark, str(tmp_path / "updates"), "*.parquet", UPDATE_SCHEMA, files_per_trigger=1)
    got = ingest.run_status_stream(spark, stream)
    assert sorted(map(tuple, got.drop("updated_at").collect())) == sorted(map(tuple, ingest.latest_status(everything).drop("updated_at").collect()))
    assert {(r["user_id"], r["appid"]): (r["actual_rating"], r["status"], r["notes"]) for r in got.collect()}[(1, 10)] == (7.0, "played", "first")


def test_reviews_resume_without_duplicates(spark, tmp_path):
    schema, base = "review_id string, ts timestamp", str(tmp_path)
    day = dt.datetime(2024, 1, 1)

    def drain():
        rows = ingest.file_stream(spark, f"{base}/in", "*.parquet", schema)
        ingest.append_new_reviews(rows, dt.datetime(2023, 1, 1), f"{base}/out", f"{base}/checkpoint")

    spark.createDataFrame([("a", day), ("b", day), ("old", dt.datetime(2020, 1, 1))], schema).write.parquet(f"{base}/in")
    drain()
    spark.createDataFrame([("b", day), ("c", day)], schema).write.mode("append").parquet(f"{base}/in")
    drain()
    assert sorted(r[0] for r in spark.read.schema(schema).parquet(f"{base}/out").select("review_id").collect()) == ["a", "b", "c"]
