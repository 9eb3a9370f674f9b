"""Numeric functions as column expressions, and a few special functions for the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    total = sum(e[1:], e[0])
    return [v / total for v in e]


def cross_entropy(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def inverse_yeo_johnson(y: Column, lam: float) -> Column:
    up = F.expm1(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if abs(lam - 2) < 1e-12 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


# Coefficients of the published rational approximation of the inverse normal distribution (Acklam).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _poly(x: Column, c) -> Column:
    out = F.lit(float(c[0]))
    for v in c[1:]:
        out = out * x + float(v)
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution by rational approximation (relative error about 1e-9)."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    mid = _poly(r, ACKLAM_A) * q / _poly(r, (*ACKLAM_B, 1.0))
    tail = lambda v: _poly(v, ACKLAM_C) / _poly(v, (*ACKLAM_D, 1.0))
    low, high = F.sqrt(-2 * F.ln(F.least(p, F.lit(0.5)))), F.sqrt(-2 * F.ln(F.least(1 - p, F.lit(0.5))))
    return F.when(p < ACKLAM_LOW, tail(low)).when(p > 1 - ACKLAM_LOW, -tail(high)).otherwise(mid)


def digamma(x):
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def lgamma(x):
    return np.vectorize(math.lgamma)(np.asarray(x, float))


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def distance(a: list[Column], b: list[Column], metric: str = "euclidean") -> Column:
    """Euclidean, Manhattan or cosine distance of two rows of columns."""
    total = lambda xs: sum(xs[1:], xs[0])
    if metric == "euclidean":
        return F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))
    if metric == "manhattan":
        return total([F.abs(x - y) for x, y in zip(a, b, strict=True)])
    na, nb = F.sqrt(total([x * x for x in a])), F.sqrt(total([y * y for y in b]))
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(1 - total([x * y for x, y in zip(a, b, strict=True)]) / F.nullif(na * nb, F.lit(0.0)))
