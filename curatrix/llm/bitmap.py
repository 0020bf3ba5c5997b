"""Membership in a set of 64-bit keys as a bitmap of fixed size: a broadcast bounded whatever the set, with false positives only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.words import mix


CHUNK = 4096


def _packed(key, table):
    """The words of one chunk as bytes."""
    out = np.zeros(CHUNK, np.uint64)
    np.bitwise_or.at(out, table["word"].to_numpy() % CHUNK, table["mask"].to_numpy().view(np.uint64))
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})


def dense(words: DataFrame, bits: int, kinds: int = 1) -> np.ndarray:
    """Bitmaps (kinds x bits / 64) from (kind, word, mask); chunks of ``CHUNK`` words come to the driver as bytes."""
    out = np.zeros((kinds, max(CHUNK, bits // 64)), np.uint64)
    chunks = words.select("kind", "word", "mask").groupBy("kind", F.expr(f"word div {CHUNK}").cast("int").alias("chunk")).applyInArrow(_packed, "kind int, chunk int, data binary")
    for row in chunks.collect():  # bounded by kinds x bits; an iterator would be a job for every partition
        out[row["kind"], row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] |= np.frombuffer(row["data"], np.uint64)
    return np.ascontiguousarray(out[:, :bits // 64])


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """uint64 words with a bit for every key modulo ``bits`` (a power of two)."""
    spot = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(spot.alias("spot")).groupBy(F.expr("spot div 64").cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))).alias("mask"))
    return dense(words.withColumn("kind", F.lit(0)), bits)[0]


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some uint64 ``keys`` may be in the set."""
    spot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def marks(*columns: pa.Array) -> np.ndarray:
    """One uint64 for each row of some integer columns; nulls count as 0."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = mix(out ^ column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return out


def marked(rows: DataFrame, *names: str) -> DataFrame:
    """(mark) of some integer columns, equal to ``marks``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(marks(*(batch.column(n) for n in names)).view(np.int64))], names=["mark"])

    return rows.select(*names).mapInArrow(run, "mark long")


def kept(rows: DataFrame, known, *names: str) -> DataFrame:
    """Rows that may be in a broadcast bitmap: of the keys in one column, or of the ``marks`` of several."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(n) for n in names]
            keys = marks(*columns) if len(columns) > 1 else columns[0].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(contains(known.value, keys)))

    return rows.mapInArrow(run, rows.schema)
