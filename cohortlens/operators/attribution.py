"""Exact local attribution of linear models.

A feature's contribution to a row's prediction is ``coefficient · (value - mean)``;
a row's contributions and the mean prediction add up to its prediction.  The
number of features is that of the schema, so a row's contributions are one small
array: ranking them and keeping the first k needs no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.linear_cv import fold_grams, solve


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]

    @property
    def base(self) -> float:
        """The prediction at the means of all features."""
        return self.intercept + sum(c * m for c, m in zip(self.coefficients, self.means, strict=True))


def fit_linear(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0, mix: float = 0.0) -> LinearFit:
    """A linear fit from one pass of sums (objective as in ``linear_cv``) over the
    rows that have the label and all features."""
    names = [*features, label]
    whole = df.dropna(subset=names)
    row = whole.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    if not row["n"]:
        raise ValueError("no row has the label and all features")
    shift = np.array([row[f"m{i}"] for i in range(len(names))])
    gram = next(iter(fold_grams(whole.withColumn("_fold", F.lit(0)), features, label, "_fold", shift).values()))
    p = len(features)
    keep = [*range(p), 2 * p, 2 * p + 1]
    coef, _ = solve(gram[np.ix_(keep, keep)], reg, mix)
    weights = coef[:p]
    intercept = float(coef[p] + shift[p] - weights @ shift[:p])
    return LinearFit(tuple(features), tuple(map(float, weights)), intercept, tuple(map(float, shift[:p])))


def local_attribution(df: DataFrame, fit: LinearFit, keys: Sequence[str], top: int | None = None) -> DataFrame:
    """``keys..., rank, feature, contribution, share``: each row's contributions,
    the largest by size first (ties by name), all or the first ``top``.

    ``share`` is the contribution's part of the sum of sizes (null if all are 0).
    A missing value counts as the mean: it contributes nothing."""
    cells = []
    for name, c, m in zip(fit.features, fit.coefficients, fit.means, strict=True):
        part = F.coalesce(F.lit(c) * (F.col(f"`{name}`").cast("double") - F.lit(m)), F.lit(0.0))
        cells.append(F.struct((-F.abs(part)).alias("order"), F.lit(name).alias("feature"), part.alias("contribution")))
    ranked = df.select(*keys, F.sort_array(F.array(*cells)).alias("_c"))
    size = F.aggregate("_c", F.lit(0.0), lambda s, x: s - x["order"])
    ranked = ranked.withColumns({"_size": size, "_c": F.slice("_c", 1, top) if top else F.col("_c")})
    each = ranked.select(*keys, "_size", F.posexplode("_c").alias("_i", "_x"))
    return each.select(
        *keys,
        (F.col("_i") + 1).alias("rank"),
        F.col("_x.feature").alias("feature"),
        F.col("_x.contribution").alias("contribution"),
        (F.abs("_x.contribution") / F.nullif(F.col("_size"), F.lit(0.0))).alias("share"),
    )
