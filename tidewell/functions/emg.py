"""Exponentially modified Gaussian peaks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of erfc (Abramowitz and Stegun 7.1.26).
RATE, TERMS = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ROOT_TWO = 2**0.5
#: Exponents above this are out of the range of the formula.
LARGEST = 500.0


def erfc(x: Column) -> Column:
    """The complementary error function, to 1.5e-7."""
    t = 1 / (1 + RATE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(TERMS):
        poly = t * (F.lit(c) + poly)
    half = poly * F.exp(-x * x)
    return F.when(x >= 0, half).otherwise(2 - half)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / ROOT_TWO)


def density(t: Column, mu: Column, sigma: Column, tau: Column, amplitude: Column) -> Column:
    """Height at ``t`` of a Gaussian (mu, sigma) with an exponential tail tau; 0 where sigma or tau isn't positive."""
    ratio, z = sigma / tau, (t - mu) / sigma
    exponent = 0.5 * ratio * ratio - z * ratio
    value = amplitude / (2 * tau) * F.exp(exponent) * erfc((ratio - z) / ROOT_TWO)
    return F.when((sigma > 0) & (tau > 0), F.when(exponent > LARGEST, 0.0).otherwise(value)).otherwise(0.0)


def share_before(t: Column, mu: Column, sigma: Column, tau: Column) -> Column:
    """Share of the peak up to ``t``."""
    ratio, z = sigma / tau, (t - mu) / sigma
    exponent = 0.5 * ratio * ratio - z * ratio
    tail = F.exp(F.least(exponent, F.lit(LARGEST))) * normal_cdf(z - ratio)
    return F.when((sigma > 0) & (tau > 0), F.when(exponent > LARGEST, normal_cdf(z)).otherwise(normal_cdf(z) - tail)).otherwise(0.0)
