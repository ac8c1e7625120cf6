"""digamma, trigamma, ln gamma and their inverses: Columns built from ln and arithmetic, and numpy twins of the same series.

The argument is shifted up by SHIFT with the recurrence, then an asymptotic series is summed; valid for x > 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
# Coefficients of the asymptotic series in r = 1/z**2, innermost last.
DIGAMMA_TERMS = (1 / 12, 1 / 120, 1 / 252, 1 / 240, 1 / 132)
TRIGAMMA_TERMS = (1 / 6, 1 / 30, 1 / 42, 1 / 30, 5 / 66)
LGAMMA_TERMS = (1 / 12, 1 / 360, 1 / 1260, 1 / 1680, 1 / 1188)
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
DIGAMMA_1 = -0.5772156649015329
INV_STEPS = 5
SHAPE_STEPS = 8
SHAPE_MIN, SHAPE_MAX = 1e-3, 1e4
EPS = 1e-12


def _alternating(r, terms):
    """t0 - r * (t1 - r * (t2 - ...))"""
    out = terms[-1]
    for t in terms[-2::-1]:
        out = t - r * out
    return out


def _digamma(x, ln, one):
    z = x + SHIFT
    r = one / (z * z)
    out = ln(z) - one / (z * 2.0) - r * _alternating(r, DIGAMMA_TERMS)
    for j in range(SHIFT):
        out = out - one / (x + float(j))
    return out


def _trigamma(x, one):
    z = x + SHIFT
    r = one / (z * z)
    out = one / z + r * 0.5 + (r / z) * _alternating(r, TRIGAMMA_TERMS)
    for j in range(SHIFT):
        out = out + one / ((x + float(j)) * (x + float(j)))
    return out


def _lgamma(x, ln, one):
    z = x + SHIFT
    r = one / (z * z)
    out = (z - 0.5) * ln(z) - z + HALF_LN_2PI + _alternating(r, LGAMMA_TERMS) / z
    for j in range(SHIFT):
        out = out - ln(x + float(j))
    return out


def digamma(x: Column) -> Column:
    return _digamma(x, F.ln, F.lit(1.0))


def trigamma(x: Column) -> Column:
    return _trigamma(x, F.lit(1.0))


def lgamma(x: Column) -> Column:
    return _lgamma(x, F.ln, F.lit(1.0))


def np_digamma(x: np.ndarray) -> np.ndarray:
    return _digamma(np.asarray(x, float), np.log, 1.0)


def np_trigamma(x: np.ndarray) -> np.ndarray:
    return _trigamma(np.asarray(x, float), 1.0)


def np_lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float), np.log, 1.0)


def np_inv_digamma(y: np.ndarray, steps: int = INV_STEPS) -> np.ndarray:
    """x with digamma(x) = y, by Newton steps."""
    y = np.asarray(y, float)
    x = np.where(y >= -2.22, np.exp(np.minimum(y, 700.0)) + 0.5, -1.0 / (np.minimum(y, -2.2) - DIGAMMA_1))
    for _ in range(steps):
        x = x - (np_digamma(x) - y) / np_trigamma(x)
    return x


def np_gamma_shape(mean: np.ndarray, mean_log: np.ndarray, steps: int = SHAPE_STEPS) -> np.ndarray:
    """Shape of the Gamma distribution with this mean and mean logarithm, within [SHAPE_MIN, SHAPE_MAX]."""
    gap = np.maximum(np.log(np.maximum(mean, EPS)) - mean_log, EPS)
    a = np.clip(np.where(gap > 0.5, 1 / (2 * gap), 1 / gap), SHAPE_MIN, SHAPE_MAX)
    for _ in range(steps):
        a = np.clip(a - (np.log(a) - np_digamma(a) - gap) / (1 / a - np_trigamma(a)), SHAPE_MIN, SHAPE_MAX)
    return a


def with_inv_digamma(df, name: str, y: str, steps: int = INV_STEPS):
    """df with a column for the inverse of digamma; one projection for each step, as one expression would grow with a power of the steps."""
    out = df.withColumn(name, F.when(F.col(y) >= -2.22, F.exp(y) + 0.5).otherwise(F.lit(-1.0) / (F.col(y) - DIGAMMA_1)))
    for _ in range(steps):
        x = F.col(name)
        out = out.withColumn(name, x - (digamma(x) - F.col(y)) / trigamma(x))
    return out


def with_gamma_shape(df, name: str, mean: str, mean_log: str, steps: int = SHAPE_STEPS):
    """The same for np_gamma_shape."""
    gap = f"{name}__gap"
    bounded = lambda c: F.least(F.greatest(c, F.lit(SHAPE_MIN)), F.lit(SHAPE_MAX))
    out = df.withColumn(gap, F.greatest(F.ln(F.greatest(F.col(mean), F.lit(EPS))) - F.col(mean_log), F.lit(EPS)))
    out = out.withColumn(name, bounded(F.when(F.col(gap) > 0.5, F.lit(1.0) / (F.col(gap) * 2.0)).otherwise(F.lit(1.0) / F.col(gap))))
    for _ in range(steps):
        a = F.col(name)
        out = out.withColumn(name, bounded(a - (F.ln(a) - digamma(a) - F.col(gap)) / (F.lit(1.0) / a - trigamma(a))))
    return out.drop(gap)
