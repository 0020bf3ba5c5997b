"""Linear models from sums of products.

One distributed pass adds up the products of all columns, per fold where folds are asked for. Everything
after that (least squares, ridge, lasso, cross-validation, subset search, influence) needs only those
small matrices; no row is visited again except to predict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 1024

# ----------------------------------------------------------------------------- one model over all rows, by fold


@dataclass
class Products:
    """Sums of products of (1, features, target), one matrix per fold."""

    features: list[str]
    folds: list[np.ndarray]

    @property
    def total(self) -> np.ndarray:
        return np.sum(self.folds, axis=0)

    def split(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        return self.total - self.folds[fold], self.folds[fold]

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.features.index(n) for n in names]


def products(df: DataFrame, features: Sequence[str], target: str, fold: Column | None = None, folds: int = 1) -> Products:
    """Sums of products in one pass; ``fold`` numbers rows 0..folds-1."""
    width = len(features) + 2
    if width > MAX_COLUMNS or width * width * folds > 50_000_000:
        raise ValueError("too many columns or folds for driver-side matrices")
    cells = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features], F.col(target).cast("double"))
    rows = df.filter(F.col(target).isNotNull()).select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), cells.alias("z"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width, width))
        for batch in batches:
            if batch.num_rows:
                which = batch.column(0).to_numpy(zero_copy_only=False)
                z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for f in np.unique(which):
                    part = z[which == f]
                    sums[f] += part.T @ part
        yield pa.RecordBatch.from_pydict({"fold": np.arange(folds, dtype=np.int32), "m": [s.ravel() for s in sums]},
                                         schema=pa.schema([("fold", pa.int32()), ("m", pa.list_(pa.float64()))]))

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = rows.mapInArrow(add, "fold int, m array<double>")
    merged = parts.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))
    out = [np.zeros((width, width)) for _ in range(folds)]
    for r in merged.toLocalIterator():  # folds x columns^2 numbers
        out[r["fold"]] = np.asarray(r["m"]).reshape(width, width)
    return Products(list(features), out)


def fold_of(key: Column, folds: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


@dataclass
class Fit:
    index: list[int]
    intercept: float
    beta: np.ndarray

    def vector(self, width: int) -> np.ndarray:
        """Coefficients of (1, all features, target) with -1 at the target: residual form."""
        out = np.zeros(width)
        out[0] = self.intercept
        out[[i + 1 for i in self.index]] = self.beta
        out[-1] = -1.0
        return out


def _centred(m: np.ndarray, index: Sequence[int]) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    n, at = float(m[0, 0]), [i + 1 for i in index]
    mx, my = m[0, at] / n, float(m[0, -1] / n)
    xx, xy = m[np.ix_(at, at)] - n * np.outer(mx, mx), m[at, -1] - n * mx * my
    flat = np.diag(xx) <= 1e-10 * m[at, at]  # what cancellation leaves of a constant column
    xx[flat, :] = xx[:, flat] = xy[flat] = 0.0
    return n, mx, my, xx, xy


def fit(m: np.ndarray, index: Sequence[int], alpha: float = 0.0, l1_ratio: float = 0.0, standardize: bool = True, rounds: int = 2000) -> Fit:
    """Least squares, ridge (``l1_ratio`` 0), lasso (1) or elastic net in between.

    The penalty follows the common form: sum of squares + alpha * |b|^2 for ridge, and
    sum of squares / (2 n) + alpha * (l1_ratio * |b|_1 + (1 - l1_ratio) / 2 * |b|^2) otherwise. The intercept is free.
    """
    index = list(index)
    n, mx, my, xx, xy = _centred(m, index)
    scale = np.sqrt(np.maximum(np.diag(xx) / n, 0.0)) if standardize and alpha > 0 else np.ones(len(index))
    scale = np.where(scale > 1e-12, scale, 1.0)
    xs, ys = xx / np.outer(scale, scale), xy / scale
    if not index:
        b = np.zeros(0)
    elif alpha <= 0 or l1_ratio <= 0:
        b = np.linalg.lstsq(xs + alpha * np.eye(len(index)), ys, rcond=None)[0]
    else:
        b, q, c = np.zeros(len(index)), xs / n, ys / n
        soft, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
        for _ in range(rounds):
            before = b.copy()
            for j in range(len(b)):
                rest = c[j] - q[j] @ b + q[j, j] * b[j]
                b[j] = math.copysign(max(abs(rest) - soft, 0.0), rest) / (q[j, j] + ridge) if q[j, j] > 1e-15 else 0.0
            if np.max(np.abs(b - before)) < 1e-10:
                break
    beta = b / scale
    return Fit(index, float(my - mx @ beta), beta)


def rss(m: np.ndarray, model: Fit) -> float:
    v = model.vector(len(m))
    return float(max(v @ m @ v, 0.0))


def scores(m: np.ndarray, model: Fit) -> dict[str, float]:
    n = float(m[0, 0])
    error, spread = rss(m, model), float(m[-1, -1] - m[0, -1] ** 2 / n)
    return {"n": n, "r2": 1.0 - error / spread if spread > 0 else 0.0, "mse": error / n, "rmse": math.sqrt(error / n),
            "nonzero": float(np.sum(np.abs(model.beta) > 1e-9))}


def information(n: float, error: float, k: int, criterion: str) -> float:
    n, error = float(n), max(error, 1e-12)
    base = n * math.log(error / n)
    if criterion == "bic":
        return base + k * math.log(n)
    aic = base + 2 * k
    if criterion == "aic":
        return aic
    return aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf


def cross_validate(p: Products, names: Sequence[str], alphas: Sequence[float], l1_ratio: float = 0.0) -> pd.DataFrame:
    """Mean out-of-fold scores per penalty. Only fold matrices are used, for training and for testing."""
    index, out = p.index(names), []
    for alpha in alphas:
        parts = [scores(test, fit(train, index, alpha, l1_ratio)) for train, test in (p.split(f) for f in range(len(p.folds))) if test[0, 0] > 1]
        out.append((float(alpha), float(np.mean([s["r2"] for s in parts])), float(np.mean([s["mse"] for s in parts]))))
    return pd.DataFrame(out, columns=["alpha", "r2", "mse"])


def best_alpha(p: Products, names: Sequence[str], alphas: Sequence[float], l1_ratio: float = 0.0) -> float:
    table = cross_validate(p, names, alphas, l1_ratio)
    return float(table.loc[table["r2"].idxmax(), "alpha"])


def compare_sets(p: Products, sets: dict[str, Sequence[str]], alphas: Sequence[float], l1_ratio: float = 0.0) -> pd.DataFrame:
    """Best cross-validated penalty and scores of every feature set."""
    out = []
    for name, members in sets.items():
        table = cross_validate(p, members, alphas, l1_ratio)
        best = table.loc[table["r2"].idxmax()]
        out.append((name, len(members), float(best["alpha"]), float(best["r2"]), float(best["mse"])))
    return pd.DataFrame(out, columns=["features", "k", "alpha", "r2", "mse"])


def stepwise(p: Products, criterion: str = "bic", start: Sequence[str] = (), exclude: Sequence[str] = ()) -> pd.DataFrame:
    """Forward-backward search; one row per accepted step."""
    m, n = p.total, p.total[0, 0]
    names = [f for f in p.features if f not in set(exclude)]

    def cost(chosen: Sequence[str]) -> float:
        return information(n, rss(m, fit(m, p.index(chosen))), len(chosen) + 1, criterion)

    chosen = list(start)
    current, trail = cost(chosen), []
    while True:
        moves = [("add", f, chosen + [f]) for f in names if f not in chosen] + [("drop", f, [c for c in chosen if c != f]) for f in chosen]
        tried = sorted(((cost(after), kind, f, after) for kind, f, after in moves), key=lambda t: (t[0], t[2]))
        if not tried or tried[0][0] >= current - 1e-9:
            return pd.DataFrame(trail, columns=["step", "move", "feature", "value", "k"])
        current, kind, f, chosen = tried[0]
        trail.append((len(trail) + 1, kind, f, float(current), len(chosen)))


def target_correlations(p: Products) -> pd.DataFrame:
    m = p.total
    n, mx, my, xx, xy = _centred(m, range(len(p.features)))
    sy = m[-1, -1] - n * my * my
    scale = np.sqrt(np.maximum(np.diag(xx), 0) * sy)
    return pd.DataFrame({"feature": p.features, "r": np.divide(xy, scale, out=np.zeros_like(xy), where=scale > 1e-15)})


def relevant_features(p: Products, keep: int) -> list[str]:
    table = target_correlations(p).assign(a=lambda t: t["r"].abs()).sort_values(["a", "feature"], ascending=[False, True])
    return list(table["feature"].head(keep))


def learning_curve(p: Products, sizes: Sequence[int], alphas: Sequence[float]) -> pd.DataFrame:
    """Cross-validated score with the k most correlated features, k over ``sizes``."""
    order = relevant_features(p, len(p.features))
    return compare_sets(p, {str(k): order[:k] for k in sizes}, alphas)


def learning_grid(df: DataFrame, features: Sequence[str], target: str, key: Column, fractions: Sequence[float], sizes: Sequence[int], alphas: Sequence[float], folds: int = 5) -> pd.DataFrame:
    """Cross-validated score over rows and dimensions: nested shares of the rows (by a hash of ``key``) times the k most correlated features.

    One pass: a row adds to the cell of the smallest share that holds it and its fold; larger shares are running sums of cells.
    """
    shares = sorted(float(f) for f in fractions)
    draw = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) / F.lit(1e6)
    level = F.size(F.filter(F.array(*[F.lit(f) for f in shares]), lambda f: f <= draw))
    rows = df.withColumn("_level", level).filter(F.col("_level") < len(shares))
    cells = products(rows, features, target, F.col("_level") * folds + fold_of(key, folds), len(shares) * folds)
    total, out = [np.zeros_like(cells.folds[0]) for _ in range(folds)], []
    for i, share in enumerate(shares):
        total = [t + cells.folds[i * folds + f] for f, t in enumerate(total)]
        held = Products(list(features), total)
        table = learning_curve(held, sizes, alphas)
        out.append(table.assign(share=share, n=int(held.total[0, 0])))
    return pd.concat(out)[["share", "n", "k", "alpha", "r2", "mse"]]


def zero_sum_fit(m: np.ndarray, index: Sequence[int]) -> Fit:
    """Least squares with coefficients that sum to zero, by differences to the first feature."""
    index = list(index)
    n, mx, my, xx, xy = _centred(m, index)
    d = np.vstack([-np.ones(len(index) - 1), np.eye(len(index) - 1)])
    beta = d @ np.linalg.lstsq(d.T @ xx @ d, d.T @ xy, rcond=None)[0]
    return Fit(index, float(my - mx @ beta), beta)


def supervised_component(p: Products, theta: float, m: np.ndarray | None = None) -> Fit:
    """Target on the first principal component of the features whose correlation passes ``theta``."""
    whole = p.total if m is None else m
    n, mx, my, xx, xy = _centred(whole, range(len(p.features)))
    sd = np.sqrt(np.maximum(np.diag(xx), 1e-18))
    r = xy / (sd * math.sqrt(max(whole[-1, -1] - n * my * my, 1e-18)))
    index = [i for i in range(len(r)) if abs(r[i]) >= theta]
    if not index:
        return Fit([], float(my), np.zeros(0))
    part = xx[np.ix_(index, index)] / np.outer(sd[index], sd[index])
    values, directions = np.linalg.eigh(part)
    w = directions[:, -1] / sd[index]
    slope = (w @ xy[index]) / max(w @ xx[np.ix_(index, index)] @ w, 1e-18)
    return Fit(index, float(my - mx[index] @ (w * slope)), w * slope)


def supervised_pca(p: Products, thetas: Sequence[float]) -> pd.DataFrame:
    out = []
    for theta in thetas:
        parts = [scores(test, supervised_component(p, theta, train))["r2"] for train, test in (p.split(f) for f in range(len(p.folds)))]
        out.append((float(theta), len(supervised_component(p, theta).index), float(np.mean(parts))))
    return pd.DataFrame(out, columns=["theta", "k", "r2"])


def predict(df: DataFrame, p: Products, model: Fit, target: str = "predicted") -> DataFrame:
    total = F.lit(model.intercept)
    for i, b in zip(model.index, model.beta):
        if b != 0.0:
            total = total + F.lit(float(b)) * F.coalesce(F.col(p.features[i]).cast("double"), F.lit(0.0))
    return df.withColumn(target, total)


def influence(df: DataFrame, p: Products, actual: str) -> DataFrame:
    """Leverage and Cook's distance of every row, with the usual thresholds as flags."""
    m, index = p.total, list(range(len(p.features)))
    model = fit(m, index)
    n, mx, _, xx, _ = _centred(m, index)
    inverse, k = np.linalg.pinv(xx), len(index)
    mse = rss(m, model) / (n - k)
    gaps = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(float(c)) for f, c in zip(p.features, mx)]
    lever = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            lever = lever + F.lit(float(inverse[i, j])) * gaps[i] * gaps[j]
    out = predict(df, p, model).withColumn("residual", F.col(actual) - F.col("predicted")).withColumn("leverage", lever)
    cook = F.col("residual") * F.col("residual") / F.lit(k * mse) * F.col("leverage") / ((F.lit(1.0) - F.col("leverage")) * (F.lit(1.0) - F.col("leverage")))
    return out.withColumn("cooks_d", cook).withColumns({"high_leverage": F.col("leverage") > 2 * (k + 1) / n, "influential": F.col("cooks_d") > 4 / n})


def contributions(long: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Value times coefficient per item and feature (columns ``appid``, ``feature``, ``value``)."""
    return long.join(F.broadcast(coefficients.select("feature", "coefficient")), "feature").select(
        "appid", "feature", "value", (F.col("value") * F.col("coefficient")).alias("contribution"))


def error_report(df: DataFrame, actual: str, predicted: str, k: int = 30) -> DataFrame:
    """The most under- and over-predicted rows."""
    gap = df.withColumn("error", F.col(actual) - F.col(predicted))
    under = gap.orderBy(F.desc("error"), "appid").limit(k).withColumn("side", F.lit("under"))
    return under.unionByName(gap.orderBy(F.asc("error"), "appid").limit(k).withColumn("side", F.lit("over")))


def error_tags(report: DataFrame, tags: DataFrame) -> DataFrame:
    return report.join(tags.select("appid", "tag"), "appid").groupBy("side", "tag").agg(F.count("*").alias("n"))


def regression_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE, overall or per group."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(e * e).alias("_e"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count("*")).alias("_t"))
    return sums.select(*by, "n", (F.lit(1.0) - F.try_divide("_e", "_t")).alias("r2"), "mae", F.sqrt(F.col("_e") / F.col("n")).alias("rmse"))


def rbf_columns(x: Column, centres: Sequence[float], sigma: float = 1.0) -> dict[str, Column]:
    """Gaussian basis of one feature."""
    return {f"rbf_{i:02d}": F.exp(F.lit(-0.5) * F.pow((x - F.lit(float(c))) / F.lit(sigma), F.lit(2.0))) for i, c in enumerate(centres)}


def with_neutral_row(df: DataFrame, features: Sequence[str], target: str, value: float = 5.0) -> DataFrame:
    """One more training row: all features zero, target neutral."""
    row = df.sparkSession.range(1).select(*[F.lit(0.0).alias(f) for f in features], F.lit(value).alias(target))
    return df.unionByName(row, allowMissingColumns=True)


# ----------------------------------------------------------------------------- one small model per user


def user_products(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per user the upper triangle of sums of products of (1, features, target), by plain aggregates."""
    cells = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    sums = [F.sum(cells[i] * cells[j]) for i in range(len(cells)) for j in range(i, len(cells))]
    return df.groupBy("user_id").agg(F.array(*sums).alias("sums"))


def user_spreads(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per user the number of rows, the means of (features, target) and the upper triangle of their covariances, by aggregates that don't cancel."""
    cells = [F.col(c).cast("double") for c in [*features, target]]
    spread = [F.covar_pop(cells[i], cells[j]) for i in range(len(cells)) for j in range(i, len(cells))]
    return df.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.array(*[F.avg(c) for c in cells]).alias("means"), F.array(*spread).alias("spread"))


def _square(flat: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    m[np.triu_indices(width)] = flat
    return m + np.triu(m, 1).T


FIT_SCHEMA = "struct<features:array<string>,intercept:double,beta:array<double>,aicc:double,n:double,rss:double>"


def user_models(df: DataFrame, features: Sequence[str], target: str, first: str | None = None) -> DataFrame:
    """Per user: least squares on all features, or forward selection by AICc from ``first``. One row per user."""
    names, width = list(features), len(features) + 1

    @F.pandas_udf(FIT_SCHEMA)
    def solve(counts: pd.Series, means: pd.Series, spreads: pd.Series) -> pd.DataFrame:
        out = []
        for n, mean, spread in zip(counts, means, spreads):
            m = np.zeros((width + 1, width + 1))  # sums of products about the means
            m[0, 0], m[1:, 1:] = n, n * _square(np.asarray(spread), width)

            def cost(chosen: list[int]) -> float:
                return information(n, rss(m, fit(m, chosen)), len(chosen) + 1, "aicc")  # noqa: B023

            chosen = list(range(len(names))) if first is None else [names.index(first)]
            value = cost(chosen)
            if first is not None:
                while True:
                    tried = sorted((cost([*chosen, i]), i) for i in range(len(names)) if i not in chosen)
                    if not tried or not tried[0][0] < value:
                        break
                    value, chosen = tried[0][0], [*chosen, tried[0][1]]
            model = fit(m, chosen)
            level = float(mean[-1] - sum(b * mean[i] for b, i in zip(model.beta, chosen)))
            out.append({"features": [names[i] for i in chosen], "intercept": level, "beta": [float(b) for b in model.beta],
                        "aicc": value if math.isfinite(value) else None, "n": float(n), "rss": rss(m, model)})
        return pd.DataFrame(out, columns=["features", "intercept", "beta", "aicc", "n", "rss"])

    return user_spreads(df, features, target).select("user_id", solve("n", "means", "spread").alias("m")).select("user_id", "m.*")


def user_predictions(df: DataFrame, models: DataFrame, features: Sequence[str], target: str = "base") -> DataFrame:
    """Each user's model applied to rows that carry ``user_id`` and the features."""
    coefficients = models.select("user_id", "intercept", F.map_from_arrays("features", "beta").alias("_b"))
    joined = df.join(coefficients, "user_id")
    total = F.col("intercept")
    for f in features:
        total = total + F.coalesce(F.try_element_at("_b", F.lit(f)), F.lit(0.0)) * F.col(f).cast("double")
    return joined.withColumn(target, total).drop("_b", "intercept")
