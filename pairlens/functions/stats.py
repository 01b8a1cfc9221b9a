"""Closed forms as column expressions, and p-values that Spark SQL has no function for as Arrow functions of aggregates."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType


def rate(k: Column, n: Column) -> Column:
    return k / F.nullif(n, F.lit(0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n; null for n = 0."""
    n = F.nullif(n, F.lit(0))
    p, d = k / n, 1 + z * z / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / d, (mid + half) / d


def mcnemar(b: Column, c: Column, correction: bool = True) -> Column:
    """The statistic of discordant counts b and c; null if there are none."""
    return F.pow(F.greatest(F.abs(b - c) - (1 if correction else 0), F.lit(0)), F.lit(2.0)) / F.nullif(b + c, F.lit(0))


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p)) - F.asin(F.sqrt(q)))


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of a two by two table; null if chance alone agrees fully."""
    n = n11 + n10 + n01 + n00
    chance = ((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)
    return ((n11 + n00) / n - chance) / F.nullif(1 - chance, F.lit(0.0))


def log_rate_ratio(x1: Column, t1: Column, x0: Column, t0: Column) -> tuple[Column, Column]:
    """Log ratio of two rates and its standard error, a half added to each count; null for a group without tokens."""
    t1, t0 = (F.nullif(t, F.lit(0.0)) for t in (t1, t0))
    return F.log((x1 + 0.5) / t1) - F.log((x0 + 0.5) / t0), F.sqrt(1 / (x1 + 0.5) + 1 / (x0 + 0.5))


def log_odds_difference(x1: Column, t1: Column, x0: Column, t0: Column) -> tuple[Column, Column]:
    """Difference of smoothed log-odds and its standard error."""
    effect, variance = [], []
    for x, t in ((x1, t1), (x0, t0)):
        p = F.greatest(F.least((x + 1) / (t + 2), F.lit(1 - 1e-6)), F.lit(1e-6))
        effect.append(F.log(p / (1 - p)))
        variance.append(1 / F.greatest(t * p * (1 - p), F.lit(1e-9)))
    return effect[0] - effect[1], F.sqrt(variance[0] + variance[1])


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """p-value of a chi-square statistic with one degree of freedom."""
    return _each(lambda v: math.erfc(math.sqrt(max(v, 0) / 2)), x)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """The t above which lies (1 - p) / 2 on each side together with below -t; by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_p(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


@pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(student_p, t, df)


@pandas_udf(DoubleType())
def t_quantile95(df: pd.Series) -> pd.Series:
    return _each(lambda d: student_quantile(0.95, d), df)


#: U's exact distribution is counted up to this many values; beyond it, the sum of uniform draws that it tends to.
COUNTED_U = 1 << 22


@lru_cache(maxsize=16)
def _u_tail(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u from 0 to the middle, of samples of m and n values: rank sums of the m by their generating function.

    Their numbers are the coefficients of the product of (1 - q^(n + i)) / (1 - q^i) over i up to m: a division is a running
    sum in steps of i, a multiplication one shift.
    """
    top = m * n // 2
    counts = np.zeros(top + 1)
    counts[0] = 1
    for i in range(1, m + 1):
        rows = -(-len(counts) // i)
        counts = np.concatenate([counts, np.zeros(rows * i - len(counts))]).reshape(rows, i).cumsum(axis=0).ravel()[: top + 1]
        if n + i <= top:
            counts[n + i :] -= counts[: top + 1 - n - i].copy()
    return counts.cumsum() / float(math.comb(m + n, m))


def exact_u_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p-value of Mann-Whitney's U without ties, by counting rank sums of the smaller sample."""
    m, n = sorted((int(n1), int(n2)))
    low = m * n - math.ceil(max(u, m * n - u))  # as likely to be reached from below as the other from above
    if m * n <= COUNTED_U:
        return float(min(1.0, 2 * _u_tail(m, n)[low]))
    x = (low + (m + 1) / 2) / (n + 1)
    return min(1.0, 2 * math.fsum((-1) ** k * math.comb(m, k) * (x - k) ** m for k in range(int(x) + 1)) / math.factorial(m))


@pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p-value; ``ties`` is the sum of t^3 - t. Exact for small groups without ties, else normal."""

    def p(u: float, n1: float, n2: float, ties: float) -> float:
        n1, n2 = int(n1), int(n2)
        if min(n1, n2) <= 8 and ties == 0:
            return exact_u_p(u, n1, n2)
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd if sd else 0.0
        return min(1.0, math.erfc(z / math.sqrt(2)))

    return _each(p, u, n1, n2, ties)


def _tail(n: np.ndarray, k: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P(X >= k) of binomial counts of n draws at q, by their masses."""
    out, mass = np.zeros(len(n)), (1 - q) ** n
    for j in range(int(n.max(initial=0)) + 1):
        out += np.where((j >= k) & (j <= n), mass, 0)
        mass = mass * np.maximum(n - j, 0) / (j + 1) * q / np.maximum(1 - q, 1e-300)
    return out


def exact_rates(x1: np.ndarray, t1: np.ndarray, x0: np.ndarray, t0: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p-value that two Poisson rates are equal, given their sum, and the interval of their ratio: exact, for small counts.

    The first count is binomial given the sum. p adds up all counts that are no more likely than it; the interval's ends are
    the ratios at which it lies in a tail of (1 - level) / 2, found by bisection of all rows at once. A count of 0 of the
    first has a lower end of 0, of the second an upper end without bound.
    """
    x1, t1, x0, t0 = (np.asarray(v, float) for v in (x1, t1, x0, t0))
    n, share = x1 + x0, t1 / (t1 + t0)
    mass = [np.where(j <= n, [math.comb(int(m), j) if j <= m else 0 for m in n] * share**j * (1 - share) ** np.maximum(n - j, 0), 0) for j in range(int(n.max(initial=0)) + 1)]
    own = np.choose(x1.astype(int), mass) if len(mass) <= 32 else np.array([mass[int(k)][i] for i, k in enumerate(x1)])
    p = np.minimum(1, sum(np.where(m <= own * (1 + 1e-7), m, 0) for m in mass)) if mass else np.ones(len(n))
    ends = []
    for upper in (False, True):
        low, high = np.zeros(len(n)), np.ones(len(n))
        for _ in range(60):
            q = (low + high) / 2
            tail = 1 - _tail(n, x1 + 1, q) if upper else _tail(n, x1, q)  # falls with q above, rises below
            inside = tail > (1 - level) / 2 if upper else tail < (1 - level) / 2
            low, high = np.where(inside, q, low), np.where(inside, high, q)
        q = np.where(x0 == 0, 1.0, high) if upper else np.where(x1 == 0, 0.0, low)
        with np.errstate(divide="ignore"):
            ends.append(q / (1 - q) * t0 / t1)
    return p, ends[0], ends[1]


@pandas_udf(DoubleType())
def exact_rate_p(x1: pd.Series, t1: pd.Series, x0: pd.Series, t0: pd.Series) -> pd.Series:
    """Two-sided exact p-value that two Poisson rates are equal, given their sum."""
    have = x1.notna() & t1.notna() & x0.notna() & t0.notna()
    out = pd.Series(np.nan, index=x1.index, dtype="float64")
    if have.any():
        out[have] = exact_rates(x1[have], t1[have], x0[have], t0[have])[0]
    return out


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("p", "low", "high")]))
def exact_rate_test(x1: pd.Series, t1: pd.Series, x0: pd.Series, t0: pd.Series) -> pd.DataFrame:
    """``exact_rates`` of rows whose counts are all there; nulls else."""
    have = x1.notna() & t1.notna() & x0.notna() & t0.notna()
    out = pd.DataFrame({"p": np.nan, "low": np.nan, "high": np.nan}, index=x1.index, dtype="float64")
    if have.any():
        out.loc[have, ["p", "low", "high"]] = np.column_stack(exact_rates(x1[have], t1[have], x0[have], t0[have]))
    return out


def score_rate_interval(x1: Column, t1: Column, x0: Column, t0: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The ratios of two Poisson rates that the score test does not reject: the roots of its quadratic equation."""
    b, a, c = 2 * x1 * x0 + z * z * (x1 + x0), x0 * x0, x1 * x1
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    scale = t0 / F.nullif(t1, F.lit(0.0))
    return 2 * c / F.nullif(b + root, F.lit(0.0)) * scale, F.when(x0 > 0, (b + root) / (2 * F.nullif(a, F.lit(0.0))) * scale).otherwise(F.lit(float("inf")))


@pandas_udf(DoubleType())
def score_rate_p(x1: pd.Series, t1: pd.Series, x0: pd.Series, t0: pd.Series) -> pd.Series:
    """Two-sided p-value of the score test that two Poisson rates are equal."""

    def p(x1: float, t1: float, x0: float, t0: float) -> float:
        r = t1 / t0
        z = (x1 - x0 * r) / math.sqrt((x1 + x0) * r) if x1 + x0 else 0.0
        return math.erfc(abs(z) / math.sqrt(2))

    return _each(p, x1, t1, x0, t0)
