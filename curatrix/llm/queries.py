"""The registered queries of this package: one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import lexical, mixing, neighbours, packing, pii, secret_scan, url_filter, whitening
from curatrix.llm.decontaminate import contaminated
from curatrix.llm.neardup import near_duplicates
from curatrix.llm.paragraphs import repeated_paragraphs
from curatrix.llm.storage import table
from curatrix.llm.suffixes import deduplicated
from curatrix.llm.toxicity import toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_quality(table(spark, sf_dir, "labels"))
    return mixing.mixed(table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents")).drop("text_key")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("component", "text_key")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffixes": op2_suffixes,
    "op3_paragraphs": op3_paragraphs,
    "op4_pii": op4_pii,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_secrets": op6_secrets,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_neighbours": op10_neighbours,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}
SQL: dict[str, str] = {
    "op1_mixing": mixing.sql(),
    "op4_pii": pii.SQL,
    "op6_secrets": secret_scan.digest_sql(),
    "op7_url_filter": url_filter.sql(),
    "op13_lexical_search": lexical.sql(),
}
