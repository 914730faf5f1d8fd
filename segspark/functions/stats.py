"""Statistics of allele counts.

Everything that SQL functions can say is a column.  Only the logarithm of rising
factorials, ln G(x + k) - ln G(x), which beta-binomials need, has no built-in; it is a
vectorised NumPy function that is used inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN2 = math.log(2)


def _tail(x: np.ndarray) -> np.ndarray:
    """What Stirling's series adds to (x - 1/2) ln x - x + ln(2 pi)/2 for x >= 8."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def _product(x: np.ndarray) -> np.ndarray:
    """x (x + 1) ... (x + 7): factors from both ends make pairs that differ by constants."""
    y = x * (x + 7)
    return y * (y + 6) * (y + 10) * (y + 12)


def ln_rising(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """ln G(x + k) - ln G(x) for x > 0, k >= 0, without the cancellation of two large terms."""
    a, b = x + 8, x + k + 8
    return (a - 0.5) * np.log1p(k / a) + k * np.log(b) - k + _tail(b) - _tail(a) + np.log(_product(x) / _product(x + k))


#: Elements at a time, so that what is computed of them stays in the processor's cache.
BLOCK = 1 << 14


def ln_beta_binomial(k: np.ndarray, n: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Log likelihood of k of n under a beta-binomial, without the binomial coefficient."""
    out = np.empty(len(k))
    for at in range(0, len(k), BLOCK):
        part = slice(at, at + BLOCK)
        kk, nn, a, b = k[part], n[part], alpha[part], beta[part]
        out[part] = ln_rising(a, kk) + ln_rising(b, nn - kk) - ln_rising(a + b, nn)
    return out


@F.pandas_udf(DoubleType())
def log_beta_binomial(k: pd.Series, n: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    return pd.Series(ln_beta_binomial(*(x.to_numpy(float) for x in (k, n, alpha, beta))))


@F.pandas_udf(DoubleType())
def ln_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    """ln of the binomial coefficient."""
    n, k = n.to_numpy(float), k.to_numpy(float)
    return pd.Series(ln_rising(n - k + 1, k) - ln_rising(np.ones_like(k), k))


def log_binomial(k: Column, n: Column, p: Column | float) -> Column:
    """Log likelihood of k of n at rate p, without the binomial coefficient."""
    p = F.lit(p) if isinstance(p, (int, float)) else p
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def binomial_p_value(k: Column, n: Column) -> Column:
    """Two-sided exact p-value of k of n at rate one half: twice the smaller tail, 1 at most.

    Terms are summed in logarithms, so large n do not underflow."""
    start = F.struct((-n * LN2).alias("term"), F.exp(-n * LN2).alias("sum"))
    less = F.least(k, n - k).cast("int")
    steps = F.when(less > 0, F.sequence(F.lit(1), less)).otherwise(F.array().cast("array<int>"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1) / i)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add, lambda a: a["sum"]))


def odd_crossovers(distance: Column, rate: Column | float, scale: Column | float = 1.0) -> Column:
    """Probability of an odd number of crossovers over a distance in base pairs."""
    return 0.5 * (1 - F.exp(-2.0 * distance * scale * rate))


def odd_variance(podd: Column, pool: Column | float) -> Column:
    return podd * (1 - podd) / pool


def beta_moments(alpha: Column, beta: Column) -> tuple[Column, Column]:
    """Mean and variance of a beta distribution."""
    total = alpha + beta
    return alpha / total, alpha * beta / (total * total * (total + 1))


def beta_params(podd: Column, pool: str, size: float, eps: float) -> tuple[Column, Column]:
    """alpha and beta of the expected allele rate in a pool (``res`` or ``sus``)."""
    mean, spread = (1 - podd, 1.0) if pool == "res" else ((1 + podd) / 3, 1 / 3)
    variance = spread * podd * (1 - podd) / size + eps * eps
    c = mean * (1 - mean) / variance - 1
    return mean * c, (1 - mean) * c


def beta_params_plain(podd: Column, pool: str, n_res: float, n_sus: float, eps: float) -> tuple[Column, Column]:
    """The earlier form: counts of expected alleles; alpha of sus is scaled by the size of res."""
    if pool == "res":
        return 2 * n_res * (1 - podd - eps), 2 * n_res * (podd + eps)
    return 2 * n_res * (1 + podd + eps) / 3, 2 * n_sus * (2 - podd - eps) / 3


def beta_arrays(podd: np.ndarray, pool: str, size: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The same over arrays.  A variance beyond what a beta distribution can have
    (c below ``FLAT``) counts as the flattest one."""
    mean, spread = (1 - podd, 1.0) if pool == "res" else ((1 + podd) / 3, 1 / 3)
    c = np.maximum(mean * (1 - mean) / (spread * podd * (1 - podd) / size + eps * eps) - 1, FLAT)
    return mean * c, (1 - mean) * c


FLAT = 1e-3


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key, alike on every run and engine."""
    name = F.concat_ws(":", *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def binomial_draw(n: int, p: Column, u: Column) -> Column:
    """The number of successes of ``n`` trials whose cumulated probability is the first to reach
    ``u``; terms follow from each other, so ``p`` should not be near to 1 for large n."""
    return F.pandas_udf(lambda p, u: pd.Series(draw_binomial(n, p.to_numpy(float), u.to_numpy(float))), "int")(p, u)


def draw_binomial(n: int, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The same over arrays: a term at a time for all that have not reached ``u``."""
    out = np.zeros(len(p), np.int32)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        for part in (slice(at, at + DRAWS) for at in range(0, len(p), DRAWS)):
            odds, aim, k = p[part] / (1 - p[part]), u[part], out[part]
            term = (1 - p[part]) ** n
            total = term.copy()
            for i in range(1, n + 1):
                open_ = ~(total >= aim)
                if not open_.any():
                    break
                k += open_
                term = term * odds * (n - i + 1) / i
                total += term
            k[p[part] >= 1] = n
    return out


#: Draws that are made together.
DRAWS = 1 << 12


def expected_at(x: Column, locus: float, rate: float, pool: float) -> list[Column]:
    """Expected rate at position ``x`` and its band."""
    podd = odd_crossovers(F.abs(x - (locus + 1e5)), rate)
    middle, band = 0.98 - podd, F.sqrt(odd_variance(podd, F.lit(pool)))
    return [middle.alias("rate"), (middle - band).alias("low"), (middle + band).alias("high")]


def ideal_at(x: Column) -> list[Column]:
    """The idealised rates of both pools at distance ``x``."""
    fall = F.exp(-F.abs(x))
    return [(0.5 + 0.5 * fall).alias("res"), (0.5 - 0.2 * fall).alias("sus")]
