"""Numeric expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import config


def clip(c: Column | str, lo: float = 0.0, hi: float = 100.0) -> Column:
    """``min(hi, max(lo, c))``; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def logistic(score: Column | str, slope: float = config.LOGISTIC_SLOPE, center: float = config.LOGISTIC_CENTER) -> Column:
    """Risk probability ``1 / (1 + exp(-slope * (center - score)))``."""
    s = F.col(score) if isinstance(score, str) else score
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-slope) * (F.lit(center) - s)))


def sample_skewness(c: Column | str) -> Column:
    """Bias-adjusted sample skewness (pandas ``Series.skew``), an aggregate expression.

    Spark's ``skewness`` is the population moment g1; the adjusted form is
    ``g1 * sqrt(n (n-1)) / (n-2)``, defined for n > 2.
    """
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
