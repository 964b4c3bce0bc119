"""Tail probabilities of test statistics.

The scalar functions are small and run on rows that are already aggregated, one per group.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()
EXACT_WILCOXON_ROWS = 50
#: Degrees of freedom from which the normal form of the t distribution is exact to nine digits.
LARGE_DF = 1e5


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 1000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return result
    raise ArithmeticError(f"incomplete beta function doesn't converge for {a}, {b}, {x}")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    if df > LARGE_DF:
        # normal tail of the statistic corrected for the degrees of freedom; the rest is of order 1 / df ** 2
        return 2.0 * normal_sf(abs(t) * (1.0 - 0.25 / df) / math.sqrt(1.0 + t * t / (2.0 * df)))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    """Number of subsets of 1..n by their sum."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(counts) - 1, rank - 1, -1):
            counts[total] += counts[total - rank]
    return tuple(counts)


def wilcoxon_p(n: int, w_plus: float, ties: float, zeros: int, alternative: str) -> float:
    """p-value of the signed-rank statistic; exact for up to 50 differences without ties or zeros."""
    if n == 0:
        return 1.0
    w_minus = n * (n + 1) / 2.0 - w_plus
    if n <= EXACT_WILCOXON_ROWS and ties == 0 and zeros == 0:
        counts = _signed_rank_counts(n)
        if alternative == "greater":
            return sum(counts[int(math.ceil(w_plus)):]) / 2.0**n
        return min(1.0, 2.0 * sum(counts[: int(math.floor(min(w_plus, w_minus))) + 1]) / 2.0**n)
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if variance <= 0:
        return 1.0
    z = (w_plus - n * (n + 1) / 4.0) / math.sqrt(variance)
    return normal_sf(z) if alternative == "greater" else min(1.0, 2.0 * normal_sf(abs(z)))


def mann_whitney_greater(n1: int, n2: int, u: float, ties: float) -> float:
    """Upper-tail p-value with tie and continuity correction."""
    total = n1 + n2
    if n1 == 0 or n2 == 0 or total < 2:
        return float("nan")
    variance = n1 * n2 / 12.0 * ((total + 1) - ties / (total * (total - 1.0)))
    if variance <= 0:
        return 1.0
    return normal_sf((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance))


# fixed values: Royston 1995 (AS R94) polynomials, lowest power first
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**power for power, c in enumerate(coefficients))


def shapiro_w_p(
    n: int, m2: float, mx: float, squares: float, first: float, second: float, next_last: float, last: float
) -> tuple[float, float]:
    """W and p from sums over the ordered sample.

    ``m2`` is the sum of squared normal scores, ``mx`` the sum of score times value, ``squares`` the sum of
    squared deviations, and the rest are the two smallest and two largest values.
    """
    if n < 3 or squares <= 0:
        return (1.0, 1.0) if n >= 3 else (float("nan"), float("nan"))
    if n == 3:
        w = (math.sqrt(0.5) * (last - first)) ** 2 / squares
        p = 6.0 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    u = 1.0 / math.sqrt(n)
    m_last = _NORMAL.inv_cdf((n - 0.375) / (n + 0.25))
    m_next = _NORMAL.inv_cdf((n - 1.375) / (n + 0.25))
    a_last = m_last / math.sqrt(m2) + _poly(_C1, u)
    inner = mx - m_last * (last - first)
    if n > 5:
        a_next = m_next / math.sqrt(m2) + _poly(_C2, u)
        phi = (m2 - 2 * m_last**2 - 2 * m_next**2) / (1 - 2 * a_last**2 - 2 * a_next**2)
        inner -= m_next * (next_last - second)
        total = inner / math.sqrt(phi) + a_last * (last - first) + a_next * (next_last - second)
    else:
        phi = (m2 - 2 * m_last**2) / (1 - 2 * a_last**2)
        total = inner / math.sqrt(phi) + a_last * (last - first)
    w = min(total * total / squares, 1.0)
    if w >= 1.0:
        return 1.0, 1.0
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(_SMALL_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        log_n = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, log_n), math.exp(_poly(_LARGE_LOG_SD, log_n))
    return w, normal_sf((y - mean) / sd)


def _mapped(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([function(*row) for row in zip(*columns)], dtype="float64")


# fixed values: Wichura 1988 (AS 241) rational approximations, lowest power first
_CENTRAL = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    def horner(values: tuple[float, ...]) -> Column:
        total = F.lit(values[-1])
        for value in reversed(values[:-1]):
            total = total * x + F.lit(value)
        return total

    return horner(coefficients[0]) / horner(coefficients[1])


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution function for 0 < p < 1, as built-in arithmetic."""
    centre = p - F.lit(0.5)
    distance = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(distance <= 5, _ratio(_TAIL, distance - F.lit(1.6))).otherwise(_ratio(_FAR_TAIL, distance - F.lit(5.0)))
    near = centre * _ratio(_CENTRAL, F.lit(0.180625) - centre * centre)
    return F.when(F.abs(centre) <= 0.425, near).when(centre < 0, -tail).otherwise(tail)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic; missing statistics stay missing."""
    return _mapped(lambda a, b: student_two_sided(a, b) if a == a and b == b and b > 0 else float("nan"), t, df)


@F.pandas_udf(T.DoubleType())
def wilcoxon_two_sided(n: pd.Series, w_plus: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return _mapped(lambda *r: wilcoxon_p(int(r[0]), r[1], r[2], int(r[3]), "two-sided"), n, w_plus, ties, zeros)


@F.pandas_udf(T.DoubleType())
def wilcoxon_greater(n: pd.Series, w_plus: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return _mapped(lambda *r: wilcoxon_p(int(r[0]), r[1], r[2], int(r[3]), "greater"), n, w_plus, ties, zeros)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    return _mapped(lambda *r: mann_whitney_greater(int(r[0]), int(r[1]), r[2], r[3]), n1, n2, u, ties)


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def shapiro_udf(
    n: pd.Series,
    m2: pd.Series,
    mx: pd.Series,
    squares: pd.Series,
    first: pd.Series,
    second: pd.Series,
    next_last: pd.Series,
    last: pd.Series,
) -> pd.DataFrame:
    rows = [shapiro_w_p(int(r[0]), *r[1:]) for r in zip(n, m2, mx, squares, first, second, next_last, last)]
    return pd.DataFrame(rows, columns=["w", "p"], dtype="float64")
