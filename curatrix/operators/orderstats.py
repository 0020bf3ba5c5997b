"""Exact order statistics by range refinement: count per range, keep the ranges that hold a wanted rank, repeat.

No buffer holds the values of a group or of the column, and no task sorts more than a leaf, whatever the group's size. Ranges are even in value, then
even in the logarithm of the value, so that neither close values nor far magnitudes stop the narrowing; a range always shrinks to the values it holds,
so each step parts its smallest from its largest value. Null and NaN are left out; a group without values gives null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024
LEAF = 4096
PASSES = 2


def _bin(v: Column, low: Column, high: Column, in_logs: bool) -> Column:
    """Which of ``BINS`` even parts of [low, high] holds ``v``; never falls as v grows, the ends are in the outer ones."""

    def scale(x: Column) -> Column:
        if not in_logs:
            return x / 2
        size = F.when(x == 0, F.lit(0.0)).otherwise(F.log2(F.abs(x)) + 1100.0)
        return F.when(x < 0, -size).otherwise(size)

    at = F.try_divide(scale(v) - scale(low), scale(high) - scale(low)) * BINS
    return F.when(v == low, 0).when(v == high, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.nanvl(at, F.lit(0.0))).cast("int"))))


def _ranks(fractions: Sequence[float], n: Column) -> Column:
    ends = [f((n - 1) * F.lit(float(p))).cast("long") for p in fractions for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ends))


def _between(p: float, n: Column, values: Column) -> Column:
    at = (n - 1) * F.lit(float(p))
    low, high = (F.try_element_at(values, f(at).cast("long")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def group_percentiles(counted: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float], count: str = "count", passes: int = PASSES, leaf: int = LEAF) -> DataFrame:
    """Percentiles (interpolated) of every group: ``by`` and a column for each name in ``fractions``.

    ``counted`` has one row for each group and value, with the number of rows it stands for. Groups of up to ``leaf`` values are read at once; the
    ranges of larger ones are narrowed ``passes`` times, each time about 1024-fold, before what is left is read in order. Nothing runs before an action.
    """
    by = list(by)
    rows = counted.select(*by, F.col(value).cast("double").alias("_v"), F.col(count).alias("_c")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = rows.groupBy(*by).agg(F.sum("_c").alias("_n"), F.count("*").alias("_levels"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = sizes.withColumn("_ranks", _ranks(list(fractions.values()), F.col("_n"))).withColumn("_before", F.lit(0).cast("long"))

    def within(ranges: DataFrame) -> DataFrame:
        named = ranges.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "_n", "_levels", "_low", "_high", "_before", "_ranks")
        same = [rows[b].eqNullSafe(named[f"_k{i}"]) for i, b in enumerate(by)]
        return rows.join(named, [*same, rows["_v"].between(named["_low"], named["_high"])]).drop(*[f"_k{i}" for i in range(len(by))])

    for turn in range(passes):
        wide = within(state.filter(F.col("_levels") > leaf)).withColumn("_bin", _bin(F.col("_v"), F.col("_low"), F.col("_high"), turn % 2 == 1))
        bins = wide.groupBy(*by, "_low", "_bin").agg(F.first("_n").alias("_n"), F.first("_before").alias("_start"), F.first("_ranks").alias("_ranks"), F.sum("_c").alias("_c"),
                                                     F.count("*").alias("_levels"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_c").over(W.partitionBy(*by, "_low").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))  # at most BINS rows
        cut = bins.withColumn("_end", F.col("_start") + upto).withColumn("_before", F.col("_end") - F.col("_c"))
        cut = cut.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_end")))).filter(F.size("_ranks") > 0)
        columns = [*by, "_n", "_levels", F.col("_low"), F.col("_high"), "_before", "_ranks"]
        narrowed = cut.drop("_low").withColumnsRenamed({"_a": "_low", "_b": "_high"}).select(*columns)
        state = state.filter(F.col("_levels") <= leaf).select(*columns).unionByName(narrowed)
    upto = F.sum("_c").over(W.partitionBy(*by, "_low").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    leaves = within(state).withColumn("_end", F.col("_before") + upto)
    hits = F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))
    found = leaves.withColumn("_rank", F.explode(hits)).groupBy(*by).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    return found.select(*by, *[_between(p, F.col("_n"), F.col("_at")).alias(name) for name, p in fractions.items()])


def percentiles(df: DataFrame, value: Column | str, fractions: Sequence[float], leaf: int = LEAF) -> list[float | None]:
    """Percentiles (interpolated) of a whole column, as numbers. Each step is one pass that returns at most ``BINS`` counts a range."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(v.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(fractions)
    wanted = sorted({int(f((n - 1) * p)) for p in fractions for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    ranges = [(low, high, 0, n, wanted)]
    turn = 0
    while ranges:
        for lo, hi, _, _, ranks in ranges:
            if lo == hi:
                found |= dict.fromkeys(ranks, lo)
        ranges = [r for r in ranges if r[0] < r[1]]
        if not ranges:
            break
        last = sum(r[3] for r in ranges) <= leaf * len(ranges)
        at, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, *_) in enumerate(ranges):
            inside = F.col("v").between(F.lit(lo), F.lit(hi))
            at = F.when(inside, i).otherwise(at)
            part = F.when(inside, _bin(F.col("v"), F.lit(lo), F.lit(hi), turn % 2 == 1)).otherwise(part)
        marked = rows.withColumn("range", at).filter(F.col("range").isNotNull())
        marked = marked.withColumn("bin", F.col("v") if last else part)
        counts = marked.groupBy("range", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("range", "bin").collect()
        following = []
        before = {i: r[2] for i, r in enumerate(ranges)}
        for row in counts:
            i = row["range"]
            ranks = [r for r in ranges[i][4] if before[i] <= r < before[i] + row["c"]]
            if ranks:
                following.append((row["lo"], row["hi"], before[i], row["c"], ranks))
            before[i] += row["c"]
        ranges, turn = following, turn + 1
    out = []
    for p in fractions:
        at = (n - 1) * p
        lo, hi = found[math.floor(at)], found[math.ceil(at)]
        out.append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
    return out
