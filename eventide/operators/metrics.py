"""Model and sample statistics as aggregates; rank-based ones run on distinct scores."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.ordered import numbered, order_statistics, quantiles, running

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLIP = 1e-6


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, null when either side has no variance.

    Added up over partitions, the variance of equal values need not be 0, so the range decides.
    """
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def probability_scores(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """n, events, Brier score and log loss."""
    q = _clip(F.col(p))
    loss = -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("long")).alias("n_events"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.avg(loss).alias("log_loss"),
    )


def _by_score(df: DataFrame, y: str, p: str, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group, F.col(p).alias("_p")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.sum((F.col(y) == 0).cast("long")).alias("_neg")
    )


def roc_auc(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with a single class."""
    cum = running(_by_score(df, y, p, group), group, ["_p"], sums={"_cn": "_neg"}, totals=True)
    wins = F.col("_pos") * (F.col("_cn") - F.col("_neg") + F.col("_neg") / F.lit(2.0))
    pairs = F.sum("_pos") * F.max("_cn_total")
    return cum.groupBy(*group).agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct thresholds of recall gained times precision; null without positives."""
    cum = running(
        _by_score(df, y, p, group), group, [F.col("_p").desc()], sums={"_tp": "_pos", "_fp": "_neg"}
    )
    gain = F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    total = F.sum("_pos")
    return cum.groupBy(*group).agg(F.when(total > 0, F.sum(gain) / total).alias("average_precision"))


def calibration_line(df: DataFrame, y: str, p: str) -> DataFrame:
    """Slope and intercept of y on logit(p); null below ten rows or with a single class."""
    logit = F.log(_clip(F.col(p)) / _clip(1 - F.col(p)))
    ok = (F.count(F.lit(1)) >= 10) & (F.count_distinct(y) == 2)
    x = df.select(F.col(y).cast("double").alias("_y"), logit.alias("_x"), y)
    return x.agg(
        F.when(ok, F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x"))).alias("calibration_slope"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
    ).select(
        "calibration_slope", (F.col("_my") - F.col("calibration_slope") * F.col("_mx")).alias("calibration_intercept")
    )


def reliability_bins(df: DataFrame, y: str, p: str, n_bins: int = 5) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; a value on an edge falls below it."""
    edges = quantiles(df, [], p, {f"e{i}": i / n_bins for i in range(1, n_bins)})
    arr = edges.select(F.array(*[F.col(f"e{i}") for i in range(1, n_bins)]).alias("e")).select("e").scalar()
    size = edges.select("n_values").scalar()
    bin_no = F.aggregate(
        F.col("_e"), F.lit(0), lambda acc, e: acc + F.when(F.col(p) > e, 1).otherwise(0)
    )
    rows = df.select(y, p, arr.alias("_e")).filter(size >= 2 * n_bins)
    return rows.groupBy(bin_no.alias("bin")).agg(
        F.avg(p).alias("predicted_mean"), F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def precision_at_k(df: DataFrame, y: str, score: str, id_col: str, k: int) -> DataFrame:
    """Share of positives among the k best scores (a distributed top-k)."""
    top = df.orderBy(F.col(score).desc(), F.col(id_col).asc()).limit(k)
    return top.agg(F.count(F.lit(1)).alias("k"), F.avg(F.col(y).cast("double")).alias("precision"))


def welch(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Two-sample comparison of flag = 1 against flag = 0: means, Welch t, df and p-value, Cohen's d."""
    v = F.col(value)
    parts = []
    for k in (1, 0):
        x = F.when(F.col(flag) == k, v)
        parts += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    s = df.agg(*parts)
    div = F.try_divide
    a, b = div(F.col("v1"), F.col("n1")), div(F.col("v0"), F.col("n0"))
    pooled = F.sqrt(
        div((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2)
    )
    return s.select(
        F.col("n1").alias("n_failure"), F.col("n0").alias("n_success"),
        F.col("m1").alias("failure_mean"), F.col("m0").alias("success_mean"),
        div(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t_stat"),
        div((a + b) * (a + b), div(a * a, F.col("n1") - 1) + div(b * b, F.col("n0") - 1)).alias("df"),
        div(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"),
    ).withColumn("p_value", t_p_value("t_stat", "df"))


def one_sample_t(df: DataFrame, value: str) -> DataFrame:
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return s.select("n", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt(F.col("n"))).alias("t_stat"),
                    (F.col("n") - 1).cast("double").alias("df"))


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation with its t statistic and p-value; null below five complete pairs."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = ok.agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("r"))
    r, n = F.col("r"), F.col("n")
    return s.select(
        "n",
        F.when(n >= 5, r).alias("correlation"),
        F.when(n >= 5, r * F.sqrt(F.try_divide(n - 2, 1 - r * r))).alias("t_stat"),
        (n - 2).cast("double").alias("df"),
    ).withColumn("p_value", t_p_value("t_stat", "df"))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for a Student variable with `df` degrees of freedom."""
    import math

    x, a, b = df / (df + t * t), df / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1 - x, b, a) / b


def t_p_value(t: str, df: str) -> Column:
    """Two-sided p-value column; meant for the one-row results of the tests above."""

    @F.pandas_udf("double")
    def _p(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([student_t_two_sided(a, b) if a == a and b > 0 else None for a, b in zip(ts, ds)])

    return _p(F.col(t), F.col(df))


def winsorized_means(df: DataFrame, value: str, caps: dict[str, float]) -> DataFrame:
    v = F.col(value)
    return df.agg(
        *[F.avg(F.greatest(F.least(v, F.lit(c)), F.lit(-c))).alias(name) for name, c in caps.items()]
    )


def trimmed_mean(df: DataFrame, value: str, id_col: str, proportion: float = 0.10) -> DataFrame:
    """Mean after dropping int(n·p) rows at each end."""
    ranked = numbered(df.select(id_col, value).filter(F.col(value).isNotNull()), [], [value, id_col], totals=True)
    k = F.floor(F.col("row_no_total") * F.lit(proportion))
    kept = ranked.filter((F.col("row_no") > k) & (F.col("row_no") <= F.col("row_no_total") - k))
    return kept.agg(F.count(F.lit(1)).alias("n_kept"), F.avg(value).alias("trimmed_mean"))


def conformal_quantile(residuals: DataFrame, residual: str, alpha: float = 0.10) -> DataFrame:
    """One row with q: the element of the sorted absolute residuals at the finite-sample level,
    rounded up to the next observation."""

    def position(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - alpha)) / n)
        return F.ceil(level * (n - 1)).cast("long")

    scores = residuals.select(F.abs(F.col(residual)).alias("_a"))
    return order_statistics(scores, [], "_a", {"q": position})


def pick_residuals(sources: list[tuple[str, DataFrame]], minimum: int = 10) -> DataFrame:
    """(source, id, residual) of the first source with at least `minimum` residuals; the last source
    needs none."""
    stacked = None
    for rank, (name, frame) in enumerate(sources):
        part = frame.filter(F.col("residual").isNotNull()).select(
            F.lit(name).alias("source"), F.lit(rank).alias("_rank"), "id", "residual"
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    counts = stacked.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n"))
    enough = (F.col("_n") >= minimum) | (F.col("_rank") == len(sources) - 1)
    chosen = counts.filter(enough).agg(F.min("_rank")).scalar()
    return stacked.filter(F.col("_rank") == chosen).drop("_rank")
