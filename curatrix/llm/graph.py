"""Connected components of a link table: by alternating large and small stars, each round a few joins; a table of at most ``FEW`` links in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.storage import forget, stored


def _down(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


FEW = 1 << 18


def _labelled(table):
    """(node, component) of a bounded link table by smallest labels and pointer jumping."""
    nodes, ends = np.unique(np.concatenate((table["u"].to_numpy(), table["v"].to_numpy())), return_inverse=True)
    u, v = ends[:table.num_rows], ends[table.num_rows:]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        fresh = label.copy()
        for side in (u, v):
            np.minimum.at(fresh, side, least)
            np.minimum.at(fresh, label[side], least)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return pa.table({"node": nodes, "component": nodes[label]})
        label = fresh


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its smallest node.

    Links may repeat and point either way; those with a null end or equal ends join nothing. No links give an empty table.
    """
    edges = stored(_down(links.select(F.col(left).alias("u"), F.col(right).alias("v"))), "edges")
    if edges.limit(FEW + 1).count() <= FEW:
        found = stored(edges.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_labelled, "node long, component long"), "components")
        forget(edges, sweep=False)
        return found
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, large = edges, stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(_down(small.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        forget(old, large, sweep=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
