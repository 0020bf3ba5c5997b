"""Normal density, distribution function and quantile as plain SQL arithmetic.

Neither Spark nor ANSI SQL ships these. Each builder returns SQL text that is valid in Spark SQL
and in other engines, so a query and its cross-check share one definition; the ``Column`` helpers
parse that text. Pass a column *name* (or a short expression): it is repeated many times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# P. J. Acklam's rational approximation of the normal quantile.
QUANTILE_CENTRE_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
                       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_CENTRE_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                       6.680131188771972e+01, -1.328068155288572e+01, 1.0)
QUANTILE_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
                     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
                     3.754408661907416e+00, 1.0)
QUANTILE_SPLIT = 0.02425

# J. F. Hart's double precision approximation of the normal distribution function.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def number(value: float) -> str:
    """A literal that every engine reads as DOUBLE (not DECIMAL)."""
    return f"({value:.17e})"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {number(c)})"
    return text


def density_sql(x: str) -> str:
    """Density of the standard normal distribution at ``x``."""
    return f"(exp(-0.5e0 * ({x}) * ({x})) * {number(0.3989422804014327)})"


def cdf_sql(x: str) -> str:
    """P(Z <= x)."""
    z = f"abs({x})"
    centre = f"(exp(-0.5e0 * ({x}) * ({x})) * {_horner(CDF_NUM, z)} / {_horner(CDF_DEN, z)})"
    chain = f"({z} + {number(0.65)})"
    for k in (4, 3, 2, 1):
        chain = f"({z} + {number(float(k))} / {chain})"
    tail = f"(exp(-0.5e0 * ({x}) * ({x})) / {chain} / {number(2.506628274631)})"
    upper = f"CASE WHEN {z} > 37e0 THEN 0e0 WHEN {z} < {number(7.07106781186547)} THEN {centre} ELSE {tail} END"
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 - ({upper}) ELSE ({upper}) END)"


def quantile_sql(p: str) -> str:
    """The ``x`` with P(Z <= x) = p, for 0 < p < 1."""
    lower_q = f"sqrt(-2e0 * ln({p}))"
    upper_q = f"sqrt(-2e0 * ln(1e0 - ({p})))"
    centre_q = f"(({p}) - 0.5e0)"
    centre_r = f"({centre_q} * {centre_q})"
    low = f"{_horner(QUANTILE_TAIL_NUM, lower_q)} / {_horner(QUANTILE_TAIL_DEN, lower_q)}"
    high = f"-({_horner(QUANTILE_TAIL_NUM, upper_q)}) / {_horner(QUANTILE_TAIL_DEN, upper_q)}"
    mid = f"{_horner(QUANTILE_CENTRE_NUM, centre_r)} * {centre_q} / {_horner(QUANTILE_CENTRE_DEN, centre_r)}"
    split = number(QUANTILE_SPLIT)
    return (f"(CASE WHEN ({p}) < {split} THEN {low} WHEN ({p}) > 1e0 - {split} THEN {high} "
            f"ELSE {mid} END)")


def density(x: str) -> Column:
    return F.expr(density_sql(x))


def cdf(x: str) -> Column:
    return F.expr(cdf_sql(x))


def quantile(p: str) -> Column:
    return F.expr(quantile_sql(p))
