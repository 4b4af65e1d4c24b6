"""Closed-form column expressions of the distance model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model constants.
EPSILON = 2.16e-05
PHI = math.sqrt(1 + 4 / 3)
SCALE = 1.5 * PHI / (1 + PHI)


def rate_coefficient(lam: Column, nbases: Column) -> Column:
    """Multiplier of 1/epsilon in the days formula; NULL when there are no bases."""
    return F.lit(SCALE) * F.try_divide(lam, nbases)


def days_from_lambda(lam: Column, nbases: Column, epsilon: float = EPSILON) -> Column:
    return rate_coefficient(lam, nbases) / F.lit(epsilon) - F.lit(SCALE * (1 - PHI) / PHI**2)


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def choose3(n: Column) -> Column:
    return n * (n - 1) * (n - 2) / 6


def clip(value: Column, lower: Column, upper: Column) -> Column:
    return F.least(F.greatest(F.coalesce(value, lower), lower), upper)


def wilson_upper(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """Upper end of the 95 % Wilson interval of a proportion."""
    p = successes / trials
    z2 = z * z
    centre = p + z2 / (2 * trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))
    return (centre + spread) / (1 + z2 / trials)


def fixed_digits(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded from the exact binary value as C's
    printf does (Spark's own formatting rounds the shortest decimal form half up)."""
    scale = float(10**digits)
    size = F.abs(x)

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * 134217729.0  # 2**27 + 1 splits a double into two exact halves
        high = big - (big - v)
        return high, v - high

    product = size * scale
    (xh, xl), (sh, sl) = halves(size), halves(F.lit(scale))
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    low = F.floor(product)
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    units = low + F.when(up, 1).otherwise(0)
    return F.concat(
        F.when(x < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", units / scale)
    )
