"""Model functions of the curve fits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26.
P = 0.3275911
A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Absolute error at most 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(P) * F.abs(x))
    poly = t * (A[0] + t * (A[1] + t * (A[2] + t * (A[3] + t * A[4]))))
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def pol1(x: Column, p: list[Column]) -> Column:
    return p[0] + p[1] * x


def pol2(x: Column, p: list[Column]) -> Column:
    return p[0] + x * (p[1] + x * p[2])


def gaussian(x: Column, p: list[Column]) -> Column:
    z = (x - p[1]) / p[2]
    return p[0] * F.exp(-z * z / 2)


def _scurve(x: Column, p: list[Column], sign: int) -> Column:
    step = F.lit(0.5) * (F.lit(1.0) + sign * erf((x - p[2]) / (F.sqrt(F.lit(2.0)) * p[3])))
    return p[0] + p[1] * x + step * (p[4] + p[5] * (x - p[2]))


def rising_scurve(x: Column, p: list[Column]) -> Column:
    return _scurve(x, p, 1)


def falling_scurve(x: Column, p: list[Column]) -> Column:
    return _scurve(x, p, -1)
