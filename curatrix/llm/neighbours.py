"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables cuts space by ``functions`` random Gaussian projections into cells of width ``width`` (times the root mean square norm
of all vectors). A query visits its own cell and ``probes`` - 1 perturbed ones per table, in the order of their estimated success: the sum of
squared distances from the query's projections to the cell walls that are crossed. Candidates of all tables are merged and ranked by
exact Euclidean distance; ties go to the smaller vec_id.

Cells are dealt over groups of about ``GROUP`` rows; a cell with more is split by vec_id, and its probes visit every part, so equal or crowded
vectors spread out and none is left out. A query that finds fewer than k is compared with all rows, tile by tile.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id; vectors only meet those of
their own length. Rows of one vec_id count once (the nearest); a query never finds its own vec_id; extra columns are ignored; empty input
gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.storage import stored

TABLES, FUNCTIONS, WIDTH, PROBES = 6, 8, 2.0, 200
GROUP = 4096


def _planes(dim: int, table: int, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng((7, dim, table))
    return rng.standard_normal((dim, functions)), rng.random(functions), rng.integers(1, 1 << 62, functions) | 1


def probe_order(inside: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """The best ``probes`` sets of (function, -1 or 1) for a point at ``inside`` (0 to 1) in its cell, best first; a heap yields them in order."""
    walls = sorted([(float(x) ** 2, k, -1) for k, x in enumerate(inside)] + [((1 - float(x)) ** 2, k, 1) for k, x in enumerate(inside)])
    found: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(walls[0][0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        picked = [walls[j][1:] for j in chosen]
        if len({k for k, _ in picked}) == len(picked):
            found.append(tuple(picked))
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (total + walls[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (total - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
    return found


def _cells(tables: int, functions: int, width: float, probes: int | None):
    """Rows (vec_id, vector) to (vec_id, vector, table, cell); with ``probes``, the cells that a query visits, without the vector."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len)):
                vectors = np.stack(part["vector"].to_numpy())
                for table in range(tables):
                    planes, shift, weights = _planes(int(dim), table, functions)
                    place = vectors @ planes / width + shift
                    low = np.floor(place)
                    base = (low.astype(np.int64) * weights).sum(axis=1) + dim
                    if probes is None:
                        yield pd.DataFrame({"vec_id": part["vec_id"], "vector": part["vector"], "table": table, "cell": base})
                        continue
                    for vec_id, cell, inside in zip(part["vec_id"], base, place - low):
                        visits = [int(cell) + sum(int(weights[k]) * d for k, d in moves) for moves in probe_order(inside, probes)]
                        wrapped = (np.array(visits, dtype=object) + (1 << 63)) % (1 << 64) - (1 << 63)
                        yield pd.DataFrame({"query_id": vec_id, "table": table, "cell": wrapped.astype(np.int64)})

    return run


def _nearest(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    gone = ids == own
    if gone.any():
        ids, vectors = ids[~gone], vectors[~gone]
    distance = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    order = np.lexsort((distance, ids))
    fresh = np.ones(len(order), bool)
    fresh[1:] = ids[order[1:]] != ids[order[:-1]]
    if not fresh.all():  # the nearest row of each vec_id, before any is left out
        ids, distance = ids[order[fresh]], distance[order[fresh]]
    if len(ids) > 4 * k:
        near = distance <= np.partition(distance, k - 1)[k - 1]
        ids, distance = ids[near], distance[near]
    order = np.lexsort((ids, distance))[:k]
    return ids[order], distance[order]


def _ranked(k: int, by_cell: bool):
    """The k nearest of each query among the rows of a group (of its cells)."""

    def run(_, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            if by_cell:
                rows = rows.sort_values("spot", kind="stable")
                spots = rows["spot"].to_numpy()
            for dim, part in rows.groupby(rows["vector"].map(len), sort=False):
                ids, vectors = part["vec_id"].to_numpy(), np.stack(part["vector"].to_numpy())
                spots = part["spot"].to_numpy() if by_cell else None
                for q in queries[queries["vector"].map(len) == dim].itertuples(index=False):
                    if by_cell:
                        visited = np.asarray(q.spots)
                        a, b = np.searchsorted(spots, visited), np.searchsorted(spots, visited, side="right")
                        n = b - a
                        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                    else:
                        at = slice(None)
                    found, distance = _nearest(ids[at], vectors[at], np.asarray(q.vector), q.query_id, k)
                    out.append(pd.DataFrame({"query_id": q.query_id, "vec_id": found, "score": distance}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector in doubles) of the rows that take part, equal rows once."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    fine = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return wide.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest ``vectors`` found for each of ``queries``; both are (vec_id, vector)."""
    vectors, queries = stored(vectors, "vectors"), stored(queries.withColumnRenamed("vec_id", "query_id"), "queries")
    scale = vectors.agg(F.avg(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    unit = width * float(np.sqrt(scale or 1.0))
    total = vectors.select("vec_id").distinct().count()

    index = vectors.mapInPandas(_cells(tables, functions, unit, None), "vec_id long, vector array<double>, table int, cell long")
    asking = max(1, -(-queries.count() // 64))
    visits = queries.selectExpr("query_id vec_id", "vector").repartition(asking).mapInPandas(_cells(tables, functions, unit, probes), "query_id long, table int, cell long").distinct()
    index = stored(index, "cells")
    groups = max(1, -(-total // GROUP))
    sizes = index.groupBy("table", "cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    spot = F.xxhash64("table", "cell", "part")
    group = F.concat_ws(":", "table", F.pmod(F.col("spot"), F.lit(groups)))
    dealt = (index.join(sizes, ["table", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
             .withColumn("spot", spot).select(group.alias("group"), "spot", "vec_id", "vector"))
    visits = visits.join(sizes, ["table", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("spot", spot)
    asked = visits.groupBy("query_id", group.alias("group")).agg(F.collect_set("spot").alias("spots")).join(queries, "query_id")
    shape = "query_id long, vec_id long, score double"
    found = dealt.groupBy("group").cogroup(asked.groupBy("group")).applyInPandas(_ranked(k, True), shape)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = stored(best, "found")

    got = best.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"))
    short = queries.join(got, F.col("query_id") == F.col("q"), "left").where(F.coalesce("n", F.lit(0)) < min(k, max(0, total - 1))).select("query_id", "vector")
    short = stored(short, "short")
    if short.limit(1).count():
        tile = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
        tiles = vectors.select(tile.alias("group"), "vec_id", "vector")
        every = short.withColumn("group", F.explode(F.sequence(F.expr("0L"), F.expr(f"{groups - 1}L"))))
        more = tiles.groupBy("group").cogroup(every.groupBy("group")).applyInPandas(_ranked(k, False), shape)
        more = more.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
