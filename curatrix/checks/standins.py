"""The given tables seen as a catalogue: items, reviews, tag votes, users' ratings, vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON_SQL = """
items AS (
  SELECT p_partkey AS appid, p_name AS name, p_name || ' ' || CAST(p_size AS VARCHAR) AS title, p_type AS genre,
         p_brand AS category, CAST(p_size AS BIGINT) AS size, p_retailprice AS price
  FROM part),
reviews AS (
  SELECT l_partkey AS appid, l_orderkey AS order_id, l_linenumber AS line, l_quantity AS playtime,
         l_returnflag <> 'R' AS voted_up, l_shipdate AS ts
  FROM lineitem),
votes AS (
  SELECT l_partkey AS appid, n_name AS tag, count(*) AS votes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
tag_names AS (SELECT DISTINCT tag FROM votes),
ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS appid, CAST(max(round(l_discount * 100)) AS INTEGER) AS rating,
         sum(l_quantity) AS playtime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
review_stats AS (
  SELECT l_partkey AS appid, count(*) FILTER (l_returnflag <> 'R') AS positive,
         count(*) FILTER (l_returnflag = 'R') AS negative, count(*) AS n,
         median(l_quantity) AS mid_playtime, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
  FROM lineitem GROUP BY 1),
catalogue AS (
  SELECT i.*, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(n, 0) AS n,
         mid_playtime, first_ts, last_ts
  FROM items i LEFT JOIN review_stats s ON i.appid = s.appid),
raw_items AS (
  SELECT p_partkey AS appid, CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_name || ' ' || CAST(p_size AS VARCHAR) END AS name,
         CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN '[''' || p_type || ''', ''Indie'']'
              ELSE p_type || ', ' || p_brand END AS genres,
         CASE p_partkey % 9 WHEN 0 THEN 'Single-player,vr only' WHEN 1 THEN NULL ELSE 'Single-player,' || p_brand END AS categories,
         CASE p_partkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'French,German' WHEN 2 THEN 'Thai,english' ELSE '' END AS languages,
         CASE p_partkey % 10 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) WHEN 1 THEN replace(printf('%.2f', p_retailprice), '.', ',')
              WHEN 2 THEN 'Free To Play' WHEN 3 THEN 'N/A' WHEN 4 THEN 'Coming Soon' WHEN 5 THEN CAST(p_size AS VARCHAR)
              WHEN 6 THEN 'Free Demo' WHEN 7 THEN 'Delisted' WHEN 8 THEN NULL ELSE CAST(p_partkey + 200 AS VARCHAR) END AS price,
         CASE WHEN p_partkey % 21 = 0 THEN '{}' WHEN p_partkey % 21 = 1 THEN NULL
              WHEN p_partkey % 21 = 2 THEN '{''Utilities'': 3, ''' || p_type || ''': 9}'
              WHEN p_partkey % 21 = 3 THEN '{''Hentai'': 2, ''' || p_brand || ''': 4}'
              ELSE '{''' || p_type || ''': ' || CAST(p_size AS VARCHAR) || ', ''' || p_brand || ''': 7}' END AS tags,
         CASE WHEN p_partkey % 6 = 0 THEN 'tiny' ELSE 'a ' || p_name || ' made of ' || p_type END AS short_description,
         CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS mature_content, p_partkey % 13 = 5 AS is_dlc,
         CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0')
              ELSE 'none' END AS positive_text,
         CAST(p_size AS BIGINT) AS size
  FROM part),
dated AS (
  SELECT o_orderkey AS appid, o_orderdate AS true_date,
         CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y')
              WHEN 2 THEN strftime(o_orderdate, '%B %Y') WHEN 3 THEN strftime(o_orderdate, '%Y %b')
              WHEN 4 THEN strftime(o_orderdate, '%-d %b, %Y') WHEN 5 THEN 'Coming soon'
              WHEN 6 THEN 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ' %Y')
              WHEN 7 THEN 'some day ' || CAST(o_custkey AS VARCHAR) WHEN 8 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE 'May 9998' END AS raw
  FROM orders),
parsed_dates AS (
  SELECT *, CASE WHEN appid % 10 IN (0, 4, 8) THEN true_date
    WHEN appid % 10 = 1 THEN CAST(make_date(year(true_date), 7, 1) AS TIMESTAMP)
    WHEN appid % 10 IN (2, 3) THEN CAST(make_date(year(true_date), month(true_date), 15) AS TIMESTAMP)
    WHEN appid % 10 = 7 THEN NULL ELSE TIMESTAMP '2000-01-01 00:00:00' END AS parsed
  FROM dated),
vectors AS (
  SELECT vec_id AS appid, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)
"""


class Tables:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived item table that one query reads several times, kept for that query."""
        if name not in self._kept:
            self._kept[name] = build().persist()
        return self._kept[name]

    def keep(self, *names: str) -> None:
        """From here on, these views are worked out once for this query and kept."""
        for name in names:
            vars(self)[name] = self.once(name, lambda: getattr(self, name))  # noqa: B023 - called at once

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title"),
            F.col("p_type").alias("genre"), F.col("p_brand").alias("category"),
            F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))

    @cached_property
    def reviews(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("appid"), F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("playtime"),
            (F.col("l_returnflag") != "R").alias("voted_up"), F.col("l_shipdate").cast("timestamp").alias("ts"))

    @cached_property
    def votes(self) -> DataFrame:
        # counted per supplier before the two dimension joins, so they see far fewer rows
        per_supplier = (self.table("lineitem").groupBy("l_partkey", "l_suppkey")
                        .agg(F.count("*").alias("c")))
        dims = (self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .select("s_suppkey", F.col("n_name").alias("tag")))
        return (per_supplier.join(dims, F.col("l_suppkey") == F.col("s_suppkey"))
                .groupBy(F.col("l_partkey").alias("appid"), "tag").agg(F.sum("c").alias("votes")))

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("appid"))
                .agg(F.max(F.round(F.col("l_discount") * 100)).cast("int").alias("rating"),
                     F.sum("l_quantity").alias("playtime")))

    @cached_property
    def review_stats(self) -> DataFrame:
        return self.reviews.groupBy("appid").agg(
            F.count_if("voted_up").alias("positive"), F.count_if(~F.col("voted_up")).alias("negative"),
            F.count("*").alias("n"), F.median("playtime").alias("mid_playtime"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.items.join(self.review_stats, "appid", "left").na.fill(0, ["positive", "negative", "n"])

    @cached_property
    def raw_items(self) -> DataFrame:
        """Items as a scraper leaves them: mixed price, genre, tag and language texts."""
        k, part = F.col("p_partkey"), self.table("part")
        size, two_digits = F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice")

        def choose(modulus, *pairs, otherwise):
            out = F
            for value, column in pairs:
                out = out.when(k % modulus == value, column)
            return out.otherwise(otherwise)

        def text(*parts):
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        null = F.lit(None).cast("string")
        return part.select(
            k.alias("appid"),
            F.when(k % 50 == 7, null).otherwise(F.concat_ws(" ", "p_name", size)).alias("name"),
            choose(11, (0, F.lit("")), (1, text("['", F.col("p_type"), "', 'Indie']")),
                   otherwise=F.concat_ws(", ", "p_type", "p_brand")).alias("genres"),
            choose(9, (0, F.lit("Single-player,vr only")), (1, null),
                   otherwise=text("Single-player,", F.col("p_brand"))).alias("categories"),
            choose(4, (0, F.lit("English")), (1, F.lit("French,German")), (2, F.lit("Thai,english")),
                   otherwise=F.lit("")).alias("languages"),
            choose(10, (0, text("$", two_digits)), (1, F.replace(two_digits, F.lit("."), F.lit(","))),
                   (2, F.lit("Free To Play")), (3, F.lit("N/A")), (4, F.lit("Coming Soon")), (5, size),
                   (6, F.lit("Free Demo")), (7, F.lit("Delisted")), (8, null),
                   otherwise=(k + 200).cast("string")).alias("price"),
            choose(21, (0, F.lit("{}")), (1, null), (2, text("{'Utilities': 3, '", F.col("p_type"), "': 9}")),
                   (3, text("{'Hentai': 2, '", F.col("p_brand"), "': 4}")),
                   otherwise=text("{'", F.col("p_type"), "': ", size, ", '", F.col("p_brand"), "': 7}")).alias("tags"),
            F.when(k % 6 == 0, F.lit("tiny")).otherwise(
                text("a ", F.col("p_name"), " made of ", F.col("p_type"))).alias("short_description"),
            F.when(k % 17 == 0, 1).otherwise(0).alias("mature_content"), (k % 13 == 5).alias("is_dlc"),
            choose(3, (0, size), (1, text("1,", F.lpad(size, 3, "0"))), otherwise=F.lit("none")).alias("positive_text"),
            F.col("p_size").cast("long").alias("size"))

    @cached_property
    def dated(self) -> DataFrame:
        """Release dates of orders in ten notations."""
        k, d = F.col("o_orderkey"), F.col("o_orderdate")
        forms = ("yyyy-MM-dd", "yyyy", "MMMM yyyy", "yyyy MMM", "d MMM, yyyy")
        raw = F
        for i, form in enumerate(forms):
            raw = raw.when(k % 10 == i, F.date_format(d, form))
        raw = (raw.when(k % 10 == 5, F.lit("Coming soon"))
               .when(k % 10 == 6, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")))
               .when(k % 10 == 7, F.concat(F.lit("some day "), F.col("o_custkey").cast("string")))
               .when(k % 10 == 8, F.date_format(d, "MMM d, yyyy")).otherwise(F.lit("May 9998")))
        return self.table("orders").select(k.alias("appid"), d.cast("timestamp").alias("true_date"), raw.alias("raw"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("appid"), F.col("embedding").cast("array<double>").alias("vec"), "label")
