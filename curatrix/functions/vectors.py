"""Vector arithmetic on ARRAY<DOUBLE> columns as built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x / length).otherwise(x))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def penalized_cosine(a: Column, b: Column, penalty: float) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(penalty))


def one_sided_cosine(a: Column, direction: Column, penalty: float, factor: float = 1.0) -> Column:
    """Score of ``a`` along a direction that keeps its own length."""
    return dot(a, direction) / (norm(a) + F.lit(penalty)) * F.lit(factor)


def weighted_jaccard(a: Column, b: Column) -> Column:
    low = array_sum(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    high = array_sum(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return low / (high + F.lit(EPS))


def softmax(values: Column, temperature: float) -> Column:
    top = F.array_max(values)
    raised = F.transform(values, lambda x: F.exp((x - top) / F.lit(temperature)))
    return scale(raised, F.lit(1.0) / array_sum(raised))


def softmin_blend(signals: Column, temperature: float = 3.0) -> Column:
    """Average of signals that leans to the smallest one."""
    low = F.array_min(signals)
    weights = F.transform(signals, lambda x: F.exp((low - x) / F.lit(temperature)))
    return array_sum(F.zip_with(signals, weights, lambda x, w: x * w)) / array_sum(weights)


def jensen_shannon_similarity(p: Column, q: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """1 - sqrt(JSD) of two distributions, optionally standardized."""
    tiny = F.lit(1e-10)

    def half(x: Column, y: Column) -> Column:
        return x * F.ln((x + tiny) / (F.lit(0.5) * (x + y + tiny)))

    divergence = F.lit(0.5) * array_sum(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)))
    similarity = F.lit(1.0) - F.sqrt(F.greatest(divergence, F.lit(0.0)))
    return (similarity - F.lit(mean)) / F.lit(std + 1e-9)


def closeness(a: Column, b: Column, width: float = 3.0) -> Column:
    """Gaussian closeness of two z-scores."""
    return F.exp(F.lit(-0.5) * F.pow((a - b) / F.lit(width), F.lit(2.0)))
