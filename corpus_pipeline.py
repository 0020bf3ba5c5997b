"""A training corpus from raw documents: five stages, each reads what its predecessor wrote.

Toxic documents go; of every group of near duplicates the first stays; documents that leak benchmark items go; live secrets are cut out
of the texts that stay; the rest is mixed to target weights. All but the last stage return the columns of ``documents``.

Every stage takes nulls in any column, blank and very long texts, repeated rows, empty tables and extra columns: null texts are empty and clean, link with
nothing, leak nothing and hold no words (so the mix takes none of them); rows without a doc_id are judged by their text and stay single;
a null source is a source; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.decontaminate import clean
from curatrix.llm.mixing import label_quality, mixed_texts
from curatrix.llm.neardup import near_duplicates
from curatrix.llm.secret_scan import without_live
from curatrix.llm.storage import stored, table
from curatrix.llm.toxicity import toxicity

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    return toxicity(docs, table(spark, sf_dir, "labels"), keep=DOCUMENT).where("predicted = 0").select(*DOCUMENT)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest doc_id; of its texts there, one. Exact repeats of a row go.

    Texts that share a doc_id but link with different groups are told apart. Rows without a doc_id and blank texts link with nothing and stay.
    """
    found = stored(near_duplicates(docs).select("doc_id", "text_key", "kept", "component"), "groups")
    linked = found.where("kept and component is not null").groupBy("doc_id", "component").agg(F.min("text_key").alias("t")).select(F.col("doc_id").alias("d"), "t")
    alone = found.where("component is null").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    stay = linked.unionByName(alone).distinct()
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).count().where("count > 1").drop("count")

    def same(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), how)

    kept = same(docs, stay, "left_semi")
    once = same(kept, again, "left_anti").select(*DOCUMENT)
    return once.unionByName(same(kept, again, "left_semi").select(*DOCUMENT).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live secrets are replaced by their kind, and n_chars follows."""
    cut = without_live(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixed_texts(docs, quality=label_quality(table(spark, sf_dir, "labels"))).select(*DOCUMENT, "taken")


STAGES = [("toxicity", drop_toxic), ("near duplicates", keep_one), ("decontamination", drop_leaks), ("secrets", cut_secrets), ("mixing", mix)]
ORACLE_SQL = None  # the first two stages learn and connect


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
