"""Cross-validated ridge and lasso from per-fold Gram matrices.

A linear fit needs the data only through sums of products.  One pass over the
rows gives those of every fold (numpy per Arrow batch, one small matrix a fold and
task); the fits of all grid points and folds, and their errors on the fold left
out, then follow from these matrices on the driver, whose size depends on the
number of features alone.  20 grid points over 5 folds are 100 fits without a
pass of their own.

Missing features (null or NaN) are filled with the median of the rows trained
on.  The matrices hold the observed values and the missing-value flags apart, so
they serve every fold's medians: a filled feature is ``value + median * flag``.

The objective is that of Spark ML's ``LinearRegression`` with its default
standardisation: on features and label of unit (population) deviation,
``1/2 |y - Xw|^2 / n + reg (mix |w|_1 + (1 - mix)/2 |w|^2) / sd(label)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketched medians, change of a lasso coefficient that ends the descent, most rounds of it.
MEDIAN_ACCURACY, TOLERANCE, ROUNDS = 10_000, 1e-12, 100_000


def _observed(name: str):
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def fold_medians(df: DataFrame, features: Sequence[str], fold: str, folds: Sequence[int]) -> np.ndarray:
    """For each fold, the features' medians over all rows but the fold's."""
    wanted = [
        F.percentile_approx(F.when(F.col(fold) != f, _observed(c)), 0.5, MEDIAN_ACCURACY).alias(f"m{i}_{j}")
        for i, f in enumerate(folds)
        for j, c in enumerate(features)
    ]
    row = df.agg(*wanted).first()
    return np.array([[row[f"m{i}_{j}"] for j in range(len(features))] for i in range(len(folds))], dtype=float)


def fold_grams(df: DataFrame, features: Sequence[str], label: str, fold: str, shift: np.ndarray) -> dict[int, np.ndarray]:
    """Per fold the sums of products of ``(features, missing flags, 1, label)``,
    each feature and the label less its ``shift`` (0 where missing)."""
    p = len(features)
    size = 2 * p + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], axis=1) - shift
            gone = np.isnan(x[:, :p])
            rows = np.concatenate([np.where(gone, 0.0, x[:, :p]), gone, np.ones((len(x), 1)), x[:, p:]], axis=1)
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for f in np.unique(at).tolist():
                mine = rows[at == f]
                sums[f] = sums.get(f, 0.0) + mine.T @ mine
        yield pa.RecordBatch.from_pydict(
            {"fold": pa.array(list(sums), pa.int64()), "s": pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))}
        )

    read = df.where(F.col(f"`{label}`").isNotNull() & F.col(fold).isNotNull())
    read = read.select(F.col(fold).cast("bigint").alias("fold"), *[_observed(c).alias(f"x{i}") for i, c in enumerate([*features, label])])
    cells = read.mapInArrow(products, "fold bigint, s array<double>").select("fold", F.posexplode("s").alias("at", "v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():  # size**2 rows a fold
        out.setdefault(r["fold"], np.zeros(size * size))[r["at"]] = r["v"]
    return {f: v.reshape(size, size) for f, v in sorted(out.items())}


def _filled(gram: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Products of ``(filled features, 1, label)``."""
    p = len(fill)
    t = np.zeros((2 * p + 2, p + 2))
    t[:p, :p], t[p : 2 * p, :p] = np.eye(p), np.diag(fill)
    t[2 * p, p] = t[2 * p + 1, p + 1] = 1.0
    return t.T @ gram @ t


def solve(gram: np.ndarray, reg: float, mix: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(coefficients..., intercept)`` and the standardised coefficients (a start
    for the next fit) of the rows behind ``gram``: Cholesky without an absolute
    part of the penalty, coordinate descent with one."""
    p = len(gram) - 2
    n = gram[p, p]
    mean = gram[p] / n
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = np.flatnonzero(sd[:p] > 1e-12 * (1 + np.abs(mean[:p])))
    w = np.zeros(p)
    if sd[-1] > 0 and len(live):
        r = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        c = cov[live, -1] / (sd[live] * sd[-1])
        flat, ridge = mix * reg / sd[-1], (1 - mix) * reg / sd[-1]
        r = r + ridge * np.eye(len(live))
        w[live] = _descend(r, c, flat, start[live] if start is not None else np.zeros(len(live))) if flat else _exact(r, c)
    coef = np.zeros(p)
    coef[live] = w[live] * sd[-1] / sd[live]
    return np.append(coef, mean[-1] - mean[:p] @ coef), w


def _exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(r, c)
    except np.linalg.LinAlgError:  # features that determine each other
        return np.linalg.lstsq(r, c, rcond=None)[0]


def _descend(r: np.ndarray, c: np.ndarray, flat: float, w: np.ndarray) -> np.ndarray:
    w = w.copy()
    for _ in range(ROUNDS):
        change = 0.0
        for j in range(len(w)):
            rest = c[j] - r[j] @ w + r[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - flat, 0.0) / r[j, j]
            change, w[j] = max(change, abs(new - w[j])), new
        if change <= TOLERANCE:
            break
    return w


def r_squared(gram: np.ndarray, coef: np.ndarray) -> float:
    """R² of a fit on the rows behind ``gram``; NaN where the label is constant."""
    v = np.append(-coef, 1.0)
    n, p = gram[-2, -2], len(gram) - 2
    total = gram[-1, -1] - gram[p, -1] ** 2 / n if n else 0.0
    return float(1 - v @ gram @ v / total) if total > 0 else float("nan")


def linear_cv(
    df: DataFrame, features: Sequence[str], label: str, fold: str, grids: Mapping[str, tuple[float, Sequence[float]]]
) -> DataFrame:
    """``model, params, reg, mean_r2, std_r2``: the R² on the fold left
    out, mean and population deviation over the folds, of each grid point.
    ``grids`` maps a model's name to its mix (1: lasso, 0: ridge) and its values.

    Rows without a label or a fold are left out.  A feature that a training part
    never has is filled with 0; there must be two folds with rows."""
    spark = df.sparkSession
    names = [*features, label]
    head = df.where(F.col(f"`{label}`").isNotNull() & F.col(fold).isNotNull())
    stats = head.agg(
        F.collect_set(F.col(fold).cast("bigint")).alias("folds"),  # a value a fold
        F.array(*[F.coalesce(F.avg(_observed(c)), F.lit(0.0)) for c in names]).alias("shift"),
        F.count_if(F.array_contains(F.array(*[_observed(c).isNull() for c in features]), True)).alias("gaps"),
    ).first()
    folds, shift = sorted(stats["folds"]), np.array(stats["shift"])
    if len(folds) < 2:
        raise ValueError(f"cross-validation needs two folds, found {len(folds)}")
    grams = fold_grams(head, features, label, fold, shift)
    p = len(features)
    fills = fold_medians(head, features, fold, folds) if stats["gaps"] else np.zeros((len(folds), p))
    # a filled value is less its shift like an observed one
    fills = np.where(np.isnan(fills), 0.0, fills) - shift[:p]
    total = sum(grams.values())
    scores: dict[tuple[str, float], list[float]] = {}
    for f, fill in zip(folds, fills, strict=True):
        train, test = _filled(total - grams[f], fill), _filled(grams[f], fill)
        for model, (mix, values) in grids.items():
            warm = None
            for reg in sorted(values, reverse=True):  # each fit starts from its neighbour's
                coef, warm = solve(train, reg, mix, warm)
                scores.setdefault((model, reg), []).append(r_squared(test, coef))
    rows = [
        (model, f"regParam={reg}", float(reg), float(np.mean(scores[model, reg])), float(np.std(scores[model, reg])))
        for model, (_, values) in grids.items()
        for reg in values
    ]
    return spark.createDataFrame(rows, "model string, params string, reg double, mean_r2 double, std_r2 double")
