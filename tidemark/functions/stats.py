"""Noise floors and other small formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C


def pooled_share(x_a: Column, n_a: Column, x_b: Column, n_b: Column) -> Column:
    """Share of both samples together, from counts; 0 where both are empty."""
    return F.when(n_a + n_b > 0, (x_a + x_b) / (n_a + n_b)).otherwise(F.lit(0.0))


def noise_floor(share: Column, n_a: Column, n_b: Column, z: float = C.SIGNIFICANCE_Z) -> Column:
    """Move of a share that sampling explains; 0 where a sample is empty."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when((n_a > 0) & (n_b > 0), F.lit(z) * F.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))).otherwise(F.lit(0.0))


def quantile_noise(n_a: Column, n_b: Column) -> Column:
    """Normalised quantile distance that sampling explains; 0 where a sample is empty."""
    n = F.least(n_a, n_b)
    return F.when(n > 0, F.lit(C.SIGNIFICANCE_Z * C.QUANTILE_NOISE_SD) / F.sqrt(n)).otherwise(F.lit(0.0))


def finite(c: Column) -> Column:
    """The value where it is a finite number, else null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def even_round(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
