"""Spans of patterns in texts, with DataFrame functions only, and the same in DuckDB SQL.

A pattern's matches and the pieces between them give all positions in time linear in the text: the end of a match is a running sum
of piece and match lengths, taken in blocks so that a text with very many matches stays cheap. Lengths are code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 512


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``java`` must match what ``plain`` matches (less what ``keep`` drops), without backtracking over long runs.

    ``keep`` names a condition on a match and ``keep_sql`` is the same on ``v`` in DuckDB; ``may`` is a cheap test of a text ``t`` that every
    match implies. ``context`` and ``against`` are words that raise and lower the score.
    """

    name: str
    java: str
    plain: str
    keep: str
    keep_sql: str
    may: str
    base: bool = True
    score: float = 0.5
    context: str = ""
    against: str = ""


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of ints."""
    zero = F.array().cast("array<bigint>")

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK))),
                         lambda b: F.slice(values, (b * _CHUNK + 1).cast("int"), _CHUNK))
    inner = F.transform(chunks, sums)
    totals = sums(F.transform(inner, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0))))
    return F.flatten(F.transform(inner, lambda c, i: F.transform(c, lambda x: x + F.coalesce(F.get(totals, i - 1), F.lit(0)))))


def with_spans(df: DataFrame, text: str, kinds: list[Kind], spans: str) -> DataFrame:
    """``df`` plus the array ``spans`` of (start, rank, end, value, before, after) of all kinds, by start, then kind.

    ``before`` and ``after`` are up to 40 code points next to the span that belong to no other span of its kind.
    """
    names = []
    for k, kind in enumerate(kinds):
        parts, hits, name = f"__p{k}", f"__h{k}", f"__s{k}"
        may = F.expr(kind.may.replace("t.", f"`{text}`"))
        df = df.withColumn(hits, F.when(may, F.regexp_extract_all(text, F.lit(kind.java), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(parts, F.when(F.size(hits) > 0, F.split(text, kind.java, -1)))
        n = F.size(hits)
        ends = running_sum(F.transform(F.arrays_zip(F.slice(parts, 1, n).alias("p"), F.col(hits).alias("h")),
                                       lambda z: (F.length(z["p"]) + F.length(z["h"])).cast("bigint")))
        zipped = F.arrays_zip(F.col(hits).alias("v"), ends.alias("e"), F.slice(parts, 1, n).alias("b"), F.slice(parts, 2, n).alias("a"))
        rank = F.lit(k)
        found = F.transform(zipped, lambda z: F.struct(
            (z["e"] - F.length(z["v"])).alias("start"), rank.alias("rank"), z["e"].alias("end"), z["v"].alias("value"),
            F.lower(F.right(z["b"], F.lit(40))).alias("before"), F.lower(F.left(z["a"], F.lit(40))).alias("after")))
        keep = _KEEPS[kind.keep]
        found = F.filter(found, lambda s: keep(s["value"]))
        empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string,before:string,after:string>>")
        df = df.withColumn(name, F.when(n > 0, found).otherwise(empty)).drop(hits, parts)
        names.append(name)
    return df.withColumn(spans, F.array_sort(F.concat(*names))).drop(*names)


_KEEPS = {}


def keeps(name: str):
    """Register a condition over a match under a name that a Kind can give as ``keep``."""
    def wrap(fn):
        _KEEPS[name] = fn
        return fn
    return wrap


@keeps("all")
def _all(v: Column) -> Column:
    return F.lit(True)


def number(spans: str, field: str, value) -> Column:
    """How many of an array's structs have ``value`` in ``field``."""
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def joined(spans: Column, kinds: list[Kind]) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def spans_sql(kinds: list[Kind], table: str = "documents") -> str:
    """CTEs ``t`` (rid and the columns of ``table``, null text empty) and ``spans`` (rid, rank, kind, start, end_, v, before, after) in DuckDB SQL."""
    parts = []
    for k, kind in enumerate(kinds):
        pattern = kind.plain.replace("'", "''")
        parts.append(f"""
SELECT rid, {k} AS rank, '{kind.name}' AS kind, end_ - length(v) AS start, end_, v, lower(right(piece, 40)) AS before, lower(left(coalesce(next, ''), 40)) AS after FROM (
  SELECT rid, i, v, piece, lead(piece) OVER (PARTITION BY rid ORDER BY i) AS next, sum(length(piece) + length(coalesce(v, ''))) OVER (PARTITION BY rid ORDER BY i) AS end_ FROM (
    SELECT rid, unnest(string_split_regex(text, '{pattern}')) AS piece, unnest(regexp_extract_all(text, '{pattern}')) AS v, unnest(range(len(string_split_regex(text, '{pattern}')))) AS i FROM t))
WHERE v IS NOT NULL AND ({kind.keep_sql})""")
    return (f"t AS (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(text, '') AS text) FROM {table}), spans AS MATERIALIZED (" + "\nUNION ALL".join(parts) + ")")


JOINED_SQL = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || end_::BIGINT, ',' ORDER BY start, rank){filter}, '')"
