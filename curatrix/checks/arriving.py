"""Streams drained with ``availableNow`` and compared with their batch meaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curatrix.checks.registry import check
from curatrix.session import shared_folder
from curatrix.streaming import ingest

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINE_SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def review_stream(t):
    lines = ingest.file_stream(t.spark, t.folder, "lineitem.parquet", LINE_SCHEMA)
    return lines.select(F.col("l_partkey").alias("appid"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("review_id"),
                        (F.col("l_returnflag") != "R").alias("voted_up"), F.col("l_quantity").alias("playtime"), F.col("l_shipdate").cast("timestamp").alias("ts"))


@check("arriving_reviews", """
SELECT DISTINCT l_orderkey || '-' || l_linenumber AS review_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'""")
def _(t):
    base = shared_folder(t.spark, "reviews")
    ingest.append_new_reviews(review_stream(t), dt.datetime(1997, 1, 1), f"{base}/rows", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/rows").select("review_id")


@check("arriving_review_counts", "SELECT appid, positive, negative, n FROM review_stats")
def _(t):
    base = shared_folder(t.spark, "counts")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number:08d}")

    ingest.drain_batches(ingest.running_counts(review_stream(t)), f"{base}/checkpoint", write, "update")
    rows = t.spark.read.parquet(f"{base}/rows")
    return rows.groupBy("appid").agg(F.max_by(F.struct("positive", "negative", "n"), "batch").alias("r")).select("appid", "r.*")


UPDATES_SQL = """
, up AS (SELECT event_id AS seq, user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS appid, CASE WHEN event_type <> 'click' THEN floor(value) % 11 END AS actual_rating, event_type = 'click' AND value < 5 AS ignore,
  CASE event_type WHEN 'view' THEN 'played' WHEN 'click' THEN 'backlog' WHEN 'purchase' THEN 'rated' END AS status, CASE WHEN value > 20 THEN 'note ' || event_id END AS notes, ts AS updated_at, event_type = 'error' AS del FROM events),
cut AS (SELECT user_id, appid, max(seq) FILTER (del) AS cut FROM up GROUP BY 1, 2), al AS (SELECT up.* FROM up JOIN cut ON up.user_id = cut.user_id AND up.appid = cut.appid WHERE cut IS NULL OR seq > cut),
st AS (SELECT user_id, appid, arg_max_null(actual_rating, seq) AS actual_rating, arg_max(ignore, seq) AS ignore, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes FROM al GROUP BY 1, 2)"""


def updates(events):
    v, kind = F.col("value"), F.col("event_type")
    return events.select(
        "user_id", (F.from_json("props", "k bigint")["k"] % 10).alias("appid"), F.when(kind != "click", F.floor(v).cast("double") % 11).alias("actual_rating"),
        ((kind == "click") & (v < 5)).alias("ignore"), F.when(kind == "view", "played").when(kind == "click", "backlog").when(kind == "purchase", "rated").alias("status"),
        F.when(v > 20, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notes"), F.col("ts").cast("timestamp").alias("updated_at"),
        (kind == "error").alias("delete"), F.col("event_id").alias("seq"))


@check("latest_status", UPDATES_SQL + " SELECT * FROM st")
def _(t):
    return ingest.latest_status(updates(t.table("events"))).drop("updated_at")


@check("arriving_status", UPDATES_SQL + " SELECT * FROM st")
def _(t):
    stream = updates(ingest.file_stream(t.spark, t.folder, "events.parquet", EVENT_SCHEMA))
    return ingest.run_status_stream(t.spark, stream).drop("updated_at")


@check("patched_pool", UPDATES_SQL + """
, pool AS (SELECT user_id % 150 AS user_id, appid % 10 AS appid, count(*) AS n FROM ratings GROUP BY 1, 2)
SELECT p.user_id, p.appid, n, coalesce(status = 'backlog', false) AS is_backlog, coalesce(status = 'wishlist', false) AS is_wishlist FROM pool p LEFT JOIN st ON p.user_id = st.user_id AND p.appid = st.appid
WHERE status IS NULL OR status NOT IN ('played', 'rated', 'ignored')""")
def _(t):
    pool = t.ratings.groupBy((F.col("user_id") % 150).alias("user_id"), (F.col("appid") % 10).alias("appid")).agg(F.count("*").alias("n"))
    return ingest.patch_pool(pool, ingest.latest_status(updates(t.table("events"))))
