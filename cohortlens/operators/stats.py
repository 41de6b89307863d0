"""Statistics and diagnostics.

Correlations are single-pass aggregate expressions (pairwise null deletion, like
pandas); ranking happens on the small result.  Ordered statistics (Durbin-Watson,
ROC) use stored ranges of a sort, with what crosses a range carried in the table
of one row per range; the only global windows are over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.prepare import ranged, running_sums


def _q(c: str):
    return F.col(f"`{c}`")


def _pair_corr(x: str, y: str):
    """Pearson correlation over rows where both are non-null."""
    both = _q(x).isNotNull() & _q(y).isNotNull()
    return F.corr(F.when(both, _q(x).cast("double")), F.when(both, _q(y).cast("double")))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(feature, corr, abs_corr, rank)``, rank 1 = largest |corr|."""
    row = df.agg(*[_pair_corr(f, target).alias(f) for f in features])
    long = row.unpivot([], list(features), "feature", "corr").withColumn("abs_corr", F.abs("corr"))
    w = Window.orderBy(F.desc_nulls_last("abs_corr"), "feature")  # len(features) rows
    return long.withColumn("rank", F.row_number().over(w))


def corr_matrix(df: DataFrame, features: Sequence[str], target: str | None = None, top_k: int | None = None) -> DataFrame:
    """Long correlation matrix ``(f1, f2, corr)``.  With a target and
    ``top_k``, only the k features most correlated (in absolute value) with it.
    All pairs and the target correlations come from one aggregate."""
    feats = list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    exprs = [_pair_corr(a, b).alias(f"{a}||{b}") for a, b in pairs]
    if target is not None:
        exprs += [_pair_corr(f, target).alias(f"{f}||@target") for f in feats]
    row = df.agg(*exprs)
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"`{a}||{b}`").alias("corr")) for a, b in pairs]
    cells += [F.struct(F.lit(b).alias("f1"), F.lit(a).alias("f2"), F.col(f"`{a}||{b}`").alias("corr")) for a, b in pairs]
    cells += [F.struct(F.lit(a).alias("f1"), F.lit(a).alias("f2"), F.lit(1.0).alias("corr")) for a in feats]
    long = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if target is None or top_k is None:
        return long
    tc = row.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.abs(F.col(f"`{f}||@target`")).alias("a")) for f in feats])).alias("t")
    ).select("t.*")
    top = tc.withColumn("_r", F.row_number().over(Window.orderBy(F.desc_nulls_last("a"), "f"))).where(F.col("_r") <= top_k)
    keep = top.select("f")
    return long.join(F.broadcast(keep.withColumnRenamed("f", "f1")), "f1").join(
        F.broadcast(keep.withColumnRenamed("f", "f2")), "f2"
    ).select("f1", "f2", "corr")


def trend_line(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, R², x range and n over pairwise non-null rows; the
    fit is null unless n > 1 and x has more than one distinct value."""
    d = df.where(_q(x).isNotNull() & _q(y).isNotNull())
    g = d.groupBy(*groups) if groups else d.groupBy()
    agg = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(_q(x)).alias("n_x"),
        F.regr_slope(_q(y), _q(x)).alias("slope"),
        F.regr_intercept(_q(y), _q(x)).alias("intercept"),
        F.regr_r2(_q(y), _q(x)).alias("r2"),
        F.min(_q(x)).alias("x_min"),
        F.max(_q(x)).alias("x_max"),
    )
    ok = (F.col("n") > 1) & (F.col("n_x") > 1)
    return agg.select(
        *groups,
        "n",
        *[F.when(ok, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")],
        "x_min",
        "x_max",
        F.when(ok, F.col("intercept") + F.col("slope") * F.col("x_min")).alias("y_at_min"),
        F.when(ok, F.col("intercept") + F.col("slope") * F.col("x_max")).alias("y_at_max"),
    )


def durbin_watson(df: DataFrame, residual: str, order: Sequence[str]) -> DataFrame:
    """Σ(e_t − e_{t−1})² / Σe_t² in ``order`` (unique).  Each row meets its
    predecessor by ``lag`` inside its range; the first row of a range meets the
    last one of the range before in the table of one row per range."""
    d = df.select(*order, F.col(residual).cast("double").alias("_e")).where(F.col("_e").isNotNull())
    inside = Window.partitionBy("_range").orderBy("_place")
    r = ranged(d, list(order)).select("_range", "_place", "_e", F.lag("_e").over(inside).alias("_prev"))
    per = r.groupBy("_range").agg(
        F.sum((F.col("_e") - F.col("_prev")) ** 2).alias("_num"),
        F.sum(F.col("_e") ** 2).alias("_den"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("_e", "_place").alias("_first"),
        F.max_by("_e", "_place").alias("_last"),
    )
    before = F.lag("_last").over(Window.orderBy("_range"))  # one row per range
    per = per.withColumn("_seam", (F.col("_first") - before) ** 2)
    agg = per.agg(
        (F.coalesce(F.sum("_num"), F.lit(0.0)) + F.coalesce(F.sum("_seam"), F.lit(0.0))).alias("_num"),
        F.sum("_den").alias("_den"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    return agg.select("n", (F.col("_num") / F.col("_den")).alias("durbin_watson"))


def category_association(df: DataFrame, categoricals: Sequence[str], target: str) -> DataFrame:
    """For each categorical column, corr(target mean of the row's category,
    target).  With n, Σy and Σy² per category the means need no join back:
    cov(m, y) = var(m), so the correlation is sqrt(var(m) / var(y))."""
    out = None
    t = _q(target).cast("double")
    for c in categoricals:
        d = df.select(F.col(c).alias("_k"), t.alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isNotNull())
        per = d.groupBy("_k").agg(F.count("_y").alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") ** 2).alias("_ss"))
        n, s = F.sum("_n"), F.sum("_s")
        tot = per.agg((F.sum(F.col("_s") ** 2 / F.col("_n")) - s * s / n).alias("_vm"), (F.sum("_ss") - s * s / n).alias("_vy"))
        part = tot.select(F.lit(c).alias("column"), F.when(F.col("_vy") > 0, F.sqrt(F.greatest("_vm", F.lit(0.0)) / F.col("_vy"))).alias("corr"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("abs_corr", F.abs("corr"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(actual, predicted, n)``."""
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class in one aggregate."""
    y = F.col(label) == F.lit(positive)
    p = F.col(prediction) == F.lit(positive)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    prec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return agg.select(
        "n", "tp", "fp", "fn", "tn",
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        (2 * prec * rec / F.nullif(prec + rec, F.lit(0))).alias("f1"),
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC points at every distinct score (descending), ties handled as one
    step.  Scores are first aggregated to ``(score, pos, neg)`` -- one row per
    distinct score -- and the running sums over that table are distributed
    (``running_sums``), since continuous scores are nearly one row each."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = d.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_sums(per, [F.desc("score")], ["pos", "neg"])
    j = cum.crossJoin(F.broadcast(tot))
    return j.select(
        "score", (F.col("cum_pos") / F.col("P")).alias("tpr"), (F.col("cum_neg") / F.col("N")).alias("fpr")
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact AUC (ties count one half) as the Mann-Whitney statistic:
    Σ over distinct scores of neg(s) · (pos above s + pos(s) / 2), / (P · N).
    Runs on the per-distinct-score table."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = d.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    above = running_sums(per, [F.desc("score")], ["pos"], prefix="above_", inclusive=False)
    above = above.withColumnRenamed("above_pos", "pos_above")
    return above.agg(
        (F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """R², MAE, RMSE, mean % error, in one aggregate."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    d = df.where(y.isNotNull() & p.isNotNull())
    g = d.groupBy(*groups) if groups else d.groupBy()
    agg = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) ** 2).alias("_sse"),
        F.var_pop(y).alias("_vy"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.abs(y - p) / F.nullif(F.abs(y), F.lit(0.0))).alias("_mape"),
    )
    return agg.select(
        *groups,
        "n",
        (1 - F.col("_sse") / (F.col("_vy") * F.col("n"))).alias("r2"),
        "mae",
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (100 * F.col("_mape")).alias("mean_pct_error"),
    )


def log_scale_metrics(df: DataFrame, label: str, log_prediction: str, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """A29 on a log1p target: R² and RMSE on the log scale; on the original scale
    (prediction back by ``expm1``) R², MAE, RMSE, mean and std of the error, and
    quantiles of its absolute value (``abs_error_p<..>``).  One row."""
    y, lp = F.col(label).cast("double"), F.col(log_prediction).cast("double")
    d = df.where(y.isNotNull() & lp.isNotNull()).select(y.alias("y"), F.log1p(y).alias("ly"), lp.alias("lp"), F.expm1(lp).alias("yp"))
    err = F.col("y") - F.col("yp")
    n = F.count(F.lit(1))
    agg = d.agg(
        n.alias("n"),
        (1 - F.sum((F.col("ly") - F.col("lp")) ** 2) / (F.var_pop("ly") * n)).alias("r2_log"),
        F.sqrt(F.avg((F.col("ly") - F.col("lp")) ** 2)).alias("rmse_log"),
        (1 - F.sum(err**2) / (F.var_pop("y") * n)).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err**2)).alias("rmse"),
        F.avg(err).alias("error_mean"),
        F.stddev_samp(err).alias("error_std"),
    )
    from cohortlens.operators.quantiles import quantiles

    qs = quantiles(d.select(F.abs(err).alias("e")), "e", list(probs), names=[f"abs_error_p{round(p * 100)}" for p in probs])
    return agg.crossJoin(F.broadcast(qs))  # one row each


def generalisation_label(gap: str = "gap") -> "F.Column":
    """|test − CV| < .01 excellent, < .05 good, else check for overfitting."""
    g = F.abs(F.col(gap))
    return F.when(g < 0.01, "Excellent").when(g < 0.05, "Good").otherwise("Overfitting risk")
