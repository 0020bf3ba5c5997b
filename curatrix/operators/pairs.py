"""Work over (candidate, seed) pairs as tiles of numpy, merged by Spark. No pair becomes a row on the way.

Candidates and seeds are cut in pieces bounded in bytes that meet once each through an equi-join key; within a task
``work`` sees one tile of at most ``TILE`` x ``TILE`` pairs at a time. It returns partial results (sums, local top lists)
that merge the same way whatever the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from curatrix.operators.toplists import top_k_by_group
from curatrix.session import checkpointed, parallelism

TILE, PIECE_BYTES, PIECE_ROWS = 1024, 64 << 20, 8192

Work = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
Whole = Callable[[list[pd.DataFrame], list[pd.DataFrame]], pd.DataFrame]


def piece_rows(df: DataFrame) -> tuple[int, int]:
    """(rows of ``df``, rows a piece may have so that its arrays stay within ``PIECE_BYTES``)."""
    widest = [F.max(F.size(f.name)) for f in df.schema if isinstance(f.dataType, ArrayType)]
    count, *widths = df.agg(F.count("*"), *widest).first()
    return count, int(max(64, min(PIECE_ROWS, PIECE_BYTES // (8 * max(1, sum(w or 0 for w in widths))))))


def tiles(frame: pd.DataFrame, size: int | None = None) -> Iterator[pd.DataFrame]:
    size = size or TILE
    for at in range(0, len(frame), size):
        yield frame.iloc[at:at + size]


def _few_pieces(candidates: DataFrame, seeds: DataFrame, rows: int | None) -> tuple[int, int]:
    """(pieces, blocks) as large as ``PIECE_BYTES`` lets them be, yet enough of them to keep all tasks busy: a piece travels once a block and a block once a piece."""
    (n, high), (m, wide) = _row_bytes(candidates), _row_bytes(seeds)
    size, tasks = rows or TILE, 4 * parallelism(candidates)
    pieces, blocks = (max(1, -(-c // min(max(64, PIECE_BYTES // b), rows or c or 1))) for c, b in ((n, high), (m, wide)))
    blocks = max(blocks, min(-(-m // size), -(-tasks // pieces)))
    return max(pieces, min(-(-n // size), -(-tasks // blocks))), blocks


def pairwise(candidates: DataFrame, seeds: DataFrame, work: Work | None, schema: str, rows: int | None = None, whole: Whole | None = None) -> DataFrame:
    """``work(candidate rows, seed rows)`` over all tiles; ``rows`` lowers the rows of a piece. ``whole`` takes all tiles of a piece and a block instead."""
    if whole is not None:
        pieces, blocks = _few_pieces(candidates, seeds, rows)
    else:
        (n, high), (m, wide) = piece_rows(candidates), piece_rows(seeds)
        pieces = max(1, min(n, max(parallelism(candidates), -(-n // min(high, rows or high)))))
        blocks = max(1, -(-m // min(wide, rows or wide)))
    left = candidates.withColumn("_piece", F.pmod(F.xxhash64(*candidates.columns), F.lit(pieces)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = seeds.withColumn("_block", F.pmod(F.xxhash64(*seeds.columns), F.lit(blocks)).cast("int")).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    right = right.toDF(*right.columns)  # fresh attributes: both sides may have one origin
    out = [f.name for f in candidates.sparkSession.createDataFrame([], schema).schema]
    size = min(TILE, rows or TILE)

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=out)
        known = list(tiles(b.drop(columns=["_piece", "_block"]), size))
        if whole is not None:
            return whole(list(tiles(a.drop(columns=["_piece", "_block"]), size)), known)
        return pd.concat([work(x, y) for x in tiles(a.drop(columns=["_piece", "_block"]), size) for y in known])

    keys = ["_block", "_piece"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(both, schema)


USER_ROWS, SHARED, WEIGHT_CELLS, SUM_CELLS = 2048, 512, 1 << 24, 1 << 18
PIECE_LISTS, BLOCK_ROWS, HELD_ROWS = 64, 4096, 1 << 18
RUN_ROWS, LONG_LIST = 64, 32


class Stacked:
    """Columns of some rows with the vectors stacked once, so that tiles of them are slices."""

    def __init__(self, columns: dict[str, pd.Series | np.ndarray], rows: int):
        self.columns, self.rows = columns, rows

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Stacked:
        vector = {c: len(frame) > 0 and isinstance(frame[c].iloc[0], np.ndarray) and frame[c].iloc[0].dtype.kind == "f" for c in frame}
        return cls({c: stack(frame[c]) if vector[c] else frame[c] for c in frame}, len(frame))

    def __len__(self) -> int:
        return self.rows

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __getitem__(self, name: str) -> pd.Series | np.ndarray:
        return self.columns[name]

    def tile(self, at: int, end: int) -> Stacked:
        end = min(end, self.rows)
        return Stacked({c: x[at:end] if isinstance(x, np.ndarray) else x.iloc[at:end] for c, x in self.columns.items()}, end - at)


def summed(items: DataFrame, rated: DataFrame, weigh: Work, value: str, shift: float) -> DataFrame:
    """(user_id, appid, num, den) of all users and items, for few users or on request: sums of ``value - shift`` and of absolute weights."""

    def work(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("user_id", kind="stable")
        users, starts = np.unique(known["user_id"].to_numpy(), return_index=True)
        w = np.where(known["appid"].to_numpy()[:, None] == rows["appid"].to_numpy()[None, :], 0.0, weigh(rows, known).T)
        num, den = (np.add.reduceat(x, starts, axis=0) for x in (w * (known[value].to_numpy(float) - shift)[:, None], np.abs(w)))
        return pd.DataFrame({"user_id": np.repeat(users, len(rows)), "appid": np.tile(rows["appid"].to_numpy(), len(users)), "num": num.ravel(), "den": den.ravel()})

    parts = pairwise(items, rated, work, "user_id long, appid long, num double, den double")
    return parts.groupBy("user_id", "appid").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def _row_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows of ``df``, bytes of its widest row's arrays)."""
    count, *widths = df.agg(F.count("*"), *[F.max(F.size(f.name)) for f in df.schema if isinstance(f.dataType, ArrayType)]).first()
    return count, 8 * (len(df.columns) + sum(w or 0 for w in widths))


def _rated_blocks(items: DataFrame, seeds: DataFrame, rated: DataFrame, facts: DataFrame | None, own: list[str], on: str, longest: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pieces of items and blocks of users that meet once each.

    In a block every rated item stands once, with its ratings as lists, so a vector travels once a block and piece however many users rated it. Blocks are as
    large as a task can hold, pieces as few as keep all tasks busy. Every piece gives ``longest`` rows a list, so pieces are many times that long where memory
    lets them, and tasks are kept busy by more blocks instead.
    """
    spark = items.sparkSession
    (n, wide), (m, _), (known, width) = _row_bytes(items), _row_bytes(rated), _row_bytes(seeds)
    limit = SHARED * USER_ROWS
    if known * width > 2 * PIECE_BYTES:
        limit = min(limit, max(USER_ROWS, 2 * PIECE_BYTES // width))
    blocks = max(1, -(-m // limit))
    tasks = min(parallelism(items), 3 * spark.sparkContext.defaultParallelism)
    pieces = max(1, min(-(-n // 256), -(-n * wide // PIECE_BYTES)), min(-(-n // max(256, PIECE_LISTS * longest)), -(-2 * tasks // blocks)))
    blocks = max(blocks, min(-(-2 * tasks // pieces), -(-m // BLOCK_ROWS)))
    span = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    left = items.withColumn("_piece", F.pmod(F.xxhash64("appid"), F.lit(pieces)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("_block")
    lists = rated.groupBy(block, on).agg(F.collect_list(F.struct("user_id", *own)).alias("_r"))
    lists = lists.select("_block", on, *[F.col(f"_r.{c}").alias(f"_{c}s") for c in ("user_id", *own)])
    right = lists.join(seeds, on).withColumns({"_piece": span, "_fact": F.lit(False), "user_id": F.lit(0).cast("long")})
    if facts is not None:
        right = right.unionByName(facts.select("*", block, span.alias("_piece"), F.lit(True).alias("_fact")).withColumn("appid", F.lit(0).cast(seeds.schema["appid"].dataType)), allowMissingColumns=True)
    return left, right.toDF(*right.columns)


def _add_products(owner: np.ndarray, gaps: np.ndarray, at: np.ndarray, w: np.ndarray, signed: bool, num: np.ndarray, den: np.ndarray) -> None:
    """Adds ``gaps`` times the weights ``w[at]`` to ``num[owner]`` and their absolute values to ``den[owner]``, as small matrix products over runs of rows.

    ``owner`` rises. All weights are finite: an owner's row of the small matrix is 0 for the others' weights.
    """
    for k in range(0, len(at), RUN_ROWS):
        mine, x = owner[k:k + RUN_ROWS], w[at[k:k + RUN_ROWS]]
        line = np.cumsum(np.diff(mine, prepend=mine[0]) != 0)
        n, row = int(line[-1]) + 1, np.arange(len(mine))
        lines = np.zeros((2 * n, len(mine)))
        lines[line, row], lines[n + line, row] = gaps[k:k + RUN_ROWS], 1.0
        whose = slice(int(mine[0]), int(mine[0]) + n) if mine[-1] - mine[0] + 1 == n else np.unique(mine)
        if signed:
            num[whose] += lines[:n] @ x
            den[whose] += lines[n:] @ np.abs(x, out=x)
        else:
            both = lines @ x
            num[whose] += both[:n]
            den[whose] += both[n:]


Lists = Callable[[pd.DataFrame, pd.DataFrame, "Raters", np.ndarray, np.ndarray], Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class Raters:
    """The ratings of a chunk of users against a tile of items: ``rows``, the ``labels`` (ids) of some of them and their ``likeness`` with the tile."""

    def __init__(self, rows: pd.DataFrame, ids: np.ndarray, base: np.ndarray):
        self.rows, self.ids, self.base = rows, ids, base

    def labels(self, some: np.ndarray) -> np.ndarray:
        return self.ids[self.rows["_at"].to_numpy()[some]].astype(str).astype(object)

    def likeness(self, some: np.ndarray) -> np.ndarray:
        return self.base[self.rows["_at"].to_numpy()[some]]


class _Best:
    """The best rows of every line of every (chunk, section), tile by tile: lines are numbers until the end, and what is below a line's edge is dropped unsorted."""

    def __init__(self, sizes: dict[str, int]):
        self.sizes, self.edges, self.names, self.held, self.fresh = sizes, {}, {}, [], 0
        self.lines, self.kept, self.cut = 0, 0, set()

    def add(self, chunk: int, section: str, who: np.ndarray, labels: np.ndarray, ids: np.ndarray, scores: np.ndarray, values: np.ndarray) -> None:
        key, k = (chunk, section), self.sizes[section]
        if key not in self.names:
            self.names[key], self.edges[key] = (self.lines, who, labels), np.full(len(who), -np.inf)
            self.lines += len(who)
        edge = self.edges[key]
        if key not in self.cut and len(ids) > k:
            rounded = np.round(scores, 9)
            rounded[np.isnan(rounded)] = -np.inf
            edge = self.edges[key] = np.maximum(edge, np.partition(rounded, len(ids) - k, axis=1)[:, len(ids) - k])
            self.cut.add(key)
        of, at = np.nonzero(scores >= np.maximum(edge - 1e-8, np.finfo(float).min)[:, None])
        score = np.round(scores[of, at], 9)
        usable = np.isfinite(score) & (score >= edge[of])  # ties at the edge stay, ids decide below
        of, at = of[usable], at[usable]
        if len(of):
            self.held.append((self.names[key][0] + of, ids[at], score[usable], values[of, at]))
            self.fresh += len(of)
        if self.fresh > max(HELD_ROWS, self.kept):
            self.tighten()

    def tighten(self) -> None:
        if not self.held:
            return
        line, ids, score, value = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, line))
        line = line[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        rank = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        length, edge = np.zeros(self.lines, np.int64), np.full(self.lines, -np.inf)
        for (chunk, section), (start, who, _) in self.names.items():
            length[start:start + len(who)] = self.sizes[section]
        last = rank == length[line] - 1
        edge[line[last]] = score[order[last]]
        for key, (start, who, _) in self.names.items():
            self.edges[key] = np.maximum(self.edges[key], edge[start:start + len(who)])
        keep = rank < length[line]
        order = order[keep]
        self.held, self.kept, self.fresh = [(line[keep], ids[order], score[order], value[order])], int(keep.sum()), 0

    def told(self) -> pd.DataFrame:
        self.tighten()
        if not self.held:
            return pd.DataFrame(columns=["user_id", "section", "label", "appid", "score", "value"])
        line, ids, score, value = self.held[0]
        who, labels = (np.concatenate([x[i] for x in self.names.values()])[line] for i in (1, 2))
        section = np.repeat(np.array([s for _, s in self.names], object), [len(x[1]) for x in self.names.values()])[line]
        return pd.DataFrame({"user_id": who, "section": section, "label": labels, "appid": ids, "score": score, "value": value})


def user_lists(items: DataFrame, seeds: DataFrame, rated: DataFrame, facts: DataFrame | None, weigh: Work, value: str, shift: float, lists: Lists, sizes: dict[str, int],
               bend: Callable[[np.ndarray, float], np.ndarray] | None = None, extra: tuple[str, ...] = (), on: str = "appid") -> DataFrame:
    """Several ranked lists of every user from one pass over the pairs: (user_id, section, label, appid, score, value, rank).

    ``rated`` (user_id, ``on``, ``value``, ``extra``) are the ratings, ``seeds`` (``on``, appid, vectors) the rated items, ``weigh(items, rated items)`` the weights of a tile;
    with ``bend`` they are bent by the power of a user's ratings (a column ``power``). An item has no weight for itself. A user's rows stay in one block. For a
    tile of items and a chunk of users, ``lists(items, facts, raters, num, den)`` yields (section, user of each line, label of each line, lines x items scores,
    lines x items values); num and den are users x items sums of weights by ``value - shift`` and of absolute weights. Scores order a list, -inf keeps an
    item out of it; ``sizes`` has each section's length. ``facts`` are at most a row a user. Only local top lists leave a task.
    """
    own = [value, *(["power"] if bend else []), *extra]
    rated = checkpointed(rated.filter(F.col("user_id").isNotNull()).select("user_id", on, *[F.col(c).cast("double").alias(c) for c in own]))
    left, right = _rated_blocks(items, seeds, rated, facts, own, on, max(sizes.values()))
    told = None if facts is None else facts.columns
    vectors = seeds.columns
    columns, by = ["user_id", "section", "label", "appid", "score", "value"], ["user_id", "section", "label"]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        given = b[~b["_fact"]]
        if not len(a) or not len(given):
            return pd.DataFrame(columns=columns)
        a = a.drop(columns=["_piece", "_block"]).reset_index(drop=True)
        rows = pd.DataFrame({**{c: np.concatenate(given[f"_{c}s"].to_numpy()) for c in ("user_id", *own)}, "_at": np.repeat(np.arange(len(given)), given["_user_ids"].map(len).to_numpy())})
        known, candidates = Stacked.of(given[vectors]), Stacked.of(a)
        facts_ = b.loc[b["_fact"], told].set_index("user_id", drop=False) if told else None
        del given, b
        # users of one power follow each other, so that bent weights serve many of them
        rows["_order"] = rows.groupby("user_id")["power"].transform("first") if bend else 0.0
        rows = rows.sort_values(["_order", "user_id"], kind="stable").reset_index(drop=True)
        first = np.flatnonzero(np.diff(rows["user_id"].to_numpy(), prepend=rows["user_id"].iloc[0] - 1))
        ends, names = np.append(first[1:], len(rows)), rows["user_id"].to_numpy()[first]
        width = int(max(16, min(TILE, WEIGHT_CELLS // len(known))))
        height = max(1, SUM_CELLS // width)
        powers, gaps, at = rows["power"].to_numpy() if bend else None, rows[value].to_numpy() - shift, rows["_at"].to_numpy()
        ids_known = known["appid"].to_numpy()
        # of the weights only the rows that ratings of a power meet are bent to it
        needed: dict[float | None, np.ndarray] = {None: np.arange(len(known))} if powers is None else {p: np.unique(at[powers == p]) for p in dict.fromkeys(powers[~np.isnan(powers)])}
        place = at.copy()
        for p, some in needed.items():
            if p is not None:
                place[powers == p] = np.searchsorted(some, at[powers == p])
        chunks = []
        for u in range(0, len(names), height):
            chunks.append((rows.iloc[first[u]:ends[min(u + height, len(names)) - 1]].reset_index(drop=True), first[u], names[u:u + height],
                           None if facts_ is None else facts_.loc[names[u:u + height]].reset_index(drop=True), first[u:u + height], ends[u:u + height]))
        best_ = _Best(sizes)
        room = np.empty((2, min(height, len(names)), min(width, len(a))))
        for start in range(0, len(a), width):
            tile, some = candidates.tile(start, start + width), a.iloc[start:start + width]
            ids = some["appid"].to_numpy()
            base = np.empty((len(known), len(ids)))
            step = max(64, (1 << 18) // len(ids))
            for k in range(0, len(known), step):
                base[k:k + step] = weigh(tile, known.tile(k, k + step)).T
            bent: tuple[float | None, np.ndarray, bool, bool] | None = None

            def weights(power: float | None) -> tuple[float | None, np.ndarray, bool, bool]:
                """(power, weights, whether all are finite, whether one is negative)."""
                nonlocal bent
                if bent is None or bent[0] != power:
                    rows_ = needed[power]
                    w = base.copy() if power is None else bend(base[rows_], power)  # noqa: B023
                    own_ = np.flatnonzero(np.isin(ids_known[rows_], ids))  # noqa: B023
                    w[own_] = np.where(ids_known[rows_][own_, None] == ids[None, :], 0.0, w[own_])  # noqa: B023
                    low, high = (w.min(), w.max()) if w.size else (0.0, 0.0)
                    bent = (power, w, bool(np.isfinite(low) and np.isfinite(high)), bool(low < 0))
                return bent

            for c, (mine, offset, users, told_, begin, end) in enumerate(chunks):
                num, den = room[:, :len(users), :len(ids)]
                num.fill(0.0)
                den.fill(0.0)
                stop = offset + len(mine)
                owner = np.repeat(np.arange(len(users)), end - begin)
                cuts = [None] if powers is None else [p for p in dict.fromkeys(powers[offset:stop]) if p in needed]
                for power in cuts:
                    _, w, finite, signed = weights(power)
                    picked = np.arange(offset, stop) if power is None else offset + np.flatnonzero(powers[offset:stop] == power)
                    if finite and len(picked) <= LONG_LIST * (np.count_nonzero(np.diff(owner[picked - offset])) + 1):
                        _add_products(owner[picked - offset], gaps[picked], place[picked], w, signed, num, den)
                        continue
                    for k in range(0, len(picked), height):
                        part = picked[k:k + height]
                        heads = np.flatnonzero(np.diff(owner[part - offset], prepend=-1))
                        whose, x = owner[part - offset][heads], w[place[part]]
                        den[whose] += np.add.reduceat(np.abs(x), heads, axis=0)
                        x *= gaps[part, None]
                        num[whose] += np.add.reduceat(x, heads, axis=0)
                told_ = pd.DataFrame({"user_id": users}) if told_ is None else told_
                for section, who, labels, scores, values in lists(some, told_, Raters(mine, ids_known, base), num, den):
                    best_.add(c, section, who, labels, ids, scores, values)
        return best_.told()[columns]

    keys = ["_block", "_piece"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "user_id long, section string, label string, appid long, score double, value double")
    ranked = top_k_by_group(local, by, [F.desc("score"), F.asc("appid")], max(sizes.values()))
    length = F.create_map(*[x for name, k in sizes.items() for x in (F.lit(name), F.lit(k))])
    return ranked.filter(F.col("rank") <= length[F.col("section")])


def user_top(items: DataFrame, seeds: DataFrame, rated: DataFrame, facts: DataFrame | None, weigh: Work, value: str, shift: float, score: Callable, k: int, name: str,
             bend: Callable[[np.ndarray, float], np.ndarray] | None = None, on: str = "appid") -> DataFrame:
    """Each user's ``k`` highest (user_id, appid, ``name``, rank), see ``user_lists``. ``score(items, facts of each user, num, den)`` is users x items; what is
    not finite is left out."""

    def one(rows: pd.DataFrame, users: pd.DataFrame, raters: Raters, num: np.ndarray, den: np.ndarray):
        values = np.asarray(score(rows, users, num, den), float)
        yield "", users["user_id"].to_numpy(), np.full(len(users), "", object), values, values

    found = user_lists(items, seeds, rated, facts, weigh, value, shift, one, {"": k}, bend, on=on)
    return found.select("user_id", "appid", F.col("value").alias(name), "rank")


def user_means(items: DataFrame, seeds: DataFrame, rated: DataFrame, weigh: Work, k: int | None, name: str) -> DataFrame:
    """Weighted mean of each user's rating deviations for every item: (user_id, appid, ``name``), or each user's ``k`` highest. ``seeds`` are the rated items' vectors."""
    rated = rated.select("user_id", "appid", "rating")
    if k is not None:
        mine = rated.join(seeds.select("appid").distinct(), "appid", "left_semi")
        return user_top(items, seeds, mine, None, weigh, "rating", 5.0, lambda rows, facts, num, den: num / (den + 1e-9), k, name)
    sums = summed(items, seeds.join(rated, "appid"), weigh, "rating", 5.0)
    return sums.select("user_id", "appid", (F.col("num") / (F.col("den") + F.lit(1e-9))).alias(name))


def stack(column: pd.Series | np.ndarray) -> np.ndarray:
    return column if isinstance(column, np.ndarray) else np.stack(column.to_numpy()).astype(np.float64)


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _divergence(a: np.ndarray, b: np.ndarray, tiny: float = 1e-10) -> np.ndarray:
    """Jensen-Shannon divergence of all rows of ``a`` and ``b``: own entropies less the cross terms with the mean, a dimension at a time."""
    own_a, own_b = (a * np.log(a + tiny)).sum(axis=1), (b * np.log(b + tiny)).sum(axis=1)
    cross = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        total = x[:, None] + y[None, :]
        cross += total * np.log((total + tiny) / 2)
    return (own_a[:, None] + own_b[None, :] - cross) / 2


def similarity_block(a: np.ndarray, b: np.ndarray, metric: str, penalty: float = 0.0) -> np.ndarray:
    """Candidates x seeds similarities: ``dot``, ``cosine`` (penalty added to the product of lengths) or ``jsd``."""
    if metric == "dot":
        return a @ b.T
    if metric == "cosine":
        return (a @ b.T) / (_lengths(a)[:, None] * _lengths(b)[None, :] + (penalty or 1e-9))
    if metric == "jsd":
        return 1.0 - np.sqrt(np.maximum(_divergence(a, b), 0.0))
    raise ValueError(f"unknown metric {metric}")


def neighbours(candidates: DataFrame, seeds: DataFrame, k: int, metric: str = "cosine", penalty: float = 0.0,
               vector: str = "vec", rows: int | None = None, barred: DataFrame | None = None) -> DataFrame:
    """Exact ``k`` nearest candidates of every seed, itself excluded: (seed, appid, similarity, rank).

    With ``barred`` (owner, appid) and seeds that carry ``owner``, every owner's barred candidates are left out before the k are taken.
    """
    extra = ["owner"] if barred is not None else []

    def nearest(candidate_tiles: list[pd.DataFrame], seed_tiles: list[pd.DataFrame]) -> pd.DataFrame:
        known = [(tile["appid"].to_numpy(), stack(tile[vector])) for tile in candidate_tiles]
        return pd.concat([best(known, wanted) for wanted in seed_tiles])

    def best(known: list[tuple[np.ndarray, np.ndarray]], wanted: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of all tiles to every seed of one; what is below the k-th so far is dropped unsorted."""
        names, vectors = wanted["appid"].to_numpy(), stack(wanted[vector])
        edge, held, fresh = np.full(len(names), -np.inf), [], 0
        for ids, rows_ in known:
            scores = similarity_block(vectors, rows_, metric, penalty)
            scores[names[:, None] == ids[None, :]] = -np.inf
            if extra:
                for j, gone in enumerate(wanted["barred"]):
                    scores[j, np.isin(ids, gone)] = -np.inf
            if len(ids) > k and not held:
                edge = np.partition(np.where(np.isfinite(scores), scores, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
            of, at = np.nonzero(scores >= edge[:, None])
            found = scores[of, at]
            usable = np.isfinite(found)
            held.append((of[usable], ids[at[usable]], found[usable]))
            fresh += int(usable.sum())
            if fresh > 4 * k * len(names):
                held, edge = tightened(held, edge)
                fresh = 0
        (of, ids, found), = tightened(held, edge)[0]
        return pd.DataFrame({**{c: wanted[c].to_numpy()[of] for c in extra}, "seed": names[of], "appid": ids, "similarity": found})

    def tightened(held: list[tuple[np.ndarray, ...]], edge: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        of, ids, found = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((ids, -found, of))  # ids decide ties
        of, ids, found = of[order], ids[order], found[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        edge = edge.copy()
        edge[of[rank == k - 1]] = found[rank == k - 1]
        return [(of[rank < k], ids[rank < k], found[rank < k])], edge

    columns = ["appid", vector, *extra]
    if barred is not None:
        lists = barred.groupBy("owner").agg(F.collect_set("appid").alias("barred"))
        seeds, columns = seeds.join(lists, "owner", "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<long>"))), [*columns, "barred"]
    shape = "owner long, seed long, appid long, similarity double" if extra else "seed long, appid long, similarity double"
    local = pairwise(candidates.select("appid", vector), seeds.select(*columns), None, shape, rows, nearest)
    return top_k_by_group(local, [*extra, "seed"], [F.desc("similarity"), F.asc("appid")], k)


def similarity_ladder(near: DataFrame, steps: tuple[int, ...] = (1, 10, 50, 100)) -> DataFrame:
    """Similarity at given neighbour ranks per seed and the drop from the first to the last of them."""
    at = [F.max(F.when(F.col("rank") == s, F.col("similarity"))).alias(f"s{s}") for s in steps]
    wide = near.filter(F.col("rank").isin(*steps)).groupBy("seed").agg(*at)
    return wide.withColumn("drop", F.col(f"s{steps[0]}") - F.col(f"s{steps[-1]}"))


MEAN_RUN = 64


def centroids(df: DataFrame, by: str, vector: str = "vec", normalize: str | None = None) -> DataFrame:
    """Mean vector per group, optionally of unit length (``l2``) or unit sum (``l1``)."""
    # a row a run of dimensions, not a row a dimension; beyond a vector's end there is nothing to count
    starts = F.sequence(F.lit(0), F.size(vector) - 1, F.lit(MEAN_RUN))
    runs = df.filter(F.size(vector) > 0).select(by, vector, F.explode(starts).alias("_at")).select(by, "_at", F.slice(vector, F.col("_at") + 1, MEAN_RUN).alias("_x"))
    sums = runs.groupBy(by, "_at").agg(F.max(F.size("_x")).alias("_n"), *[F.avg(F.get("_x", F.lit(i))).alias(f"_{i}") for i in range(MEAN_RUN)])
    parts = sums.select(by, "_at", F.slice(F.array(*[f"_{i}" for i in range(MEAN_RUN)]), F.lit(1), F.col("_n")).alias("m"))
    mean = parts.groupBy(by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "m"))), lambda e: e["m"])).alias(vector))
    if normalize is None:
        return mean
    size = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x * x if normalize == "l2" else x))
    return mean.withColumn("_n", F.sqrt(size) if normalize == "l2" else size).withColumn(
        vector, F.transform(vector, lambda x: x / (F.col("_n") + F.lit(1e-9)))).drop("_n")


def topic_distributions(df: DataFrame, topics: DataFrame, temperature: float = 0.2) -> DataFrame:
    """Softmax of each row's dot products with topic centroids (columns ``topic``, ``vec``), in order of topic: ``topics`` vector."""

    def work(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        scores = stack(rows["vec"]) @ stack(centre["vec"]).T / temperature
        return pd.DataFrame({"appid": rows["appid"].to_numpy(), "part": [[{"topic": int(t), "s": float(x)} for t, x in zip(centre["topic"], row)] for row in scores]})

    parts = pairwise(df.select("appid", "vec"), topics.select("topic", "vec"), work, "appid long, part array<struct<topic:long,s:double>>")
    scores = parts.groupBy("appid").agg(F.transform(F.array_sort(F.flatten(F.collect_list("part"))), lambda p: p["s"]).alias("s"))
    odds = scores.withColumn("top", F.array_max("s")).select("appid", F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    return odds.withColumn("total", total).select("appid", F.transform("e", lambda x: x / F.col("total")).alias("topics"))


def project_on_axis(df: DataFrame, low: DataFrame, high: DataFrame, target: str = "projection", vector: str = "vec") -> DataFrame:
    """Position along the unit axis from the centre of one anchor set to the other's."""
    def centre(anchors: DataFrame) -> Column:
        one = centroids(anchors.withColumn("_g", F.lit(1)), "_g", vector)
        return one.select(vector).scalar()

    both = df.withColumns({"_lo": centre(low), "_hi": centre(high)})
    axis = both.withColumn("_axis", F.zip_with("_hi", "_lo", lambda a, b: a - b))
    length = F.sqrt(F.aggregate("_axis", F.lit(0.0), lambda acc, x: acc + x * x)) + F.lit(1e-9)
    dot = F.aggregate(F.zip_with(vector, "_axis", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return axis.withColumn(target, dot / length).drop("_lo", "_hi", "_axis")


def diverse_seeds(items: DataFrame, count: int = 20, ceiling: float = 0.1, penalty: float = 0.5, vector: str = "vec", popularity: str = "n") -> DataFrame:
    """Most reviewed items first, each unlike all chosen before it.

    The pool is read in pages of the most reviewed items left. Accepting within a page is exact because a page
    is in order; before the next page, one distributed pass drops what the chosen seeds rule out.
    """
    page = 1000  # rows of one vector each on the driver
    left = items.select("appid", F.col(popularity).cast("long").alias(popularity), vector)
    chosen: list[tuple[int, int, np.ndarray]] = []
    while True:
        rows = left.orderBy(F.desc(popularity), "appid").limit(page).collect()
        for r in rows:
            v = np.asarray(r[vector])
            if all(v @ w / (np.linalg.norm(v) * np.linalg.norm(w) + penalty) < ceiling for _, _, w in chosen):
                chosen.append((r["appid"], r[popularity], v))
                if len(chosen) == count:
                    break
        if len(chosen) == count or len(rows) < page:
            break
        seeds = items.sparkSession.createDataFrame([(int(a), [float(x) for x in v]) for a, _, v in chosen], f"appid long, {vector} array<double>")
        last = rows[-1]

        def alike(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            sims = similarity_block(stack(batch[vector]), stack(known[vector]), "cosine", penalty)
            return batch.loc[(sims >= ceiling).any(axis=1), ["appid"]]

        after = left.filter((F.col(popularity) < last[popularity]) | ((F.col(popularity) == last[popularity]) & (F.col("appid") > last["appid"])))
        left = after.join(pairwise(after.select("appid", vector), seeds, alike, "appid long").distinct(), "appid", "left_anti")
    out = [(i + 1, int(a), int(n), [float(x) for x in v]) for i, (a, n, v) in enumerate(chosen)]
    return items.sparkSession.createDataFrame(out, f"rank int, appid long, n long, {vector} array<double>")


def modality_blend(parts: list[tuple[str, float]], rows: pd.DataFrame, seeds: pd.DataFrame, discount: np.ndarray | None, discounted: str | None) -> np.ndarray:
    """Weighted sum of cosines over several vectors; one of them may be discounted by the candidate's popularity."""
    total = np.zeros((len(rows), len(seeds)))
    for column, weight in parts:
        a, b = stack(rows[column]), stack(seeds[column])
        la, lb = _lengths(a), _lengths(b)
        sims = (a / np.where(la == 0, 1, la)[:, None]) @ (b / np.where(lb == 0, 1, lb)[:, None]).T
        total += weight * (sims * discount[:, None] if column == discounted and discount is not None else sims)
    return total


def popularity_discount(z: np.ndarray, decay: float = 0.15) -> np.ndarray:
    return np.where(z > 0, np.exp(-decay * np.maximum(z, 0)), 1.0)
