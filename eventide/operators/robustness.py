"""The robustness suite of a set of trades, from one table of replicate sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators import metrics, resample, trades
from eventide.session import stable

# Replicates of the strategy and era intervals, winsor caps, trimmed share.
STRATEGY_BOOT, ERA_BOOT, PERMUTATIONS, BLOCK_BOOT = 5000, 500, 2000, 2000
CAPS = {"winsorized_50pct": 0.5, "winsorized_30pct": 0.3, "winsorized_20pct": 0.2}
TRIM = 0.10


def _named(frame: DataFrame, prefix: Column | str = "") -> DataFrame:
    """(metric, value) of the columns of a frame with one row, or one row per prefix."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    rows = F.array(*[F.struct(F.concat(start, F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in frame.columns if not c.startswith("_")])
    return frame.select(F.explode(rows).alias("m")).select("m.*")


def suite(rows: DataFrame, ret: str, id_col: str, year: str, era: Column) -> DataFrame:
    """(metric, value): bootstrap, sign permutation, t test, year blocks, leave-one-out, winsorised and trimmed means, eras.

    The strategy's and the eras' bootstraps share one table of sums per (era, replicate): the strategy's replicate is the sum over
    eras, and an era's interval reads the first ERA_BOOT replicates. No trades give n_trades 0 only.
    """
    r = F.col(ret)
    t = stable(rows.filter(r.isNotNull()).withColumn("_era", era))
    n = t.count()
    if not n:
        return rows.sparkSession.createDataFrame([("n_trades", 0.0)], "metric string, value double")
    sums = stable(resample.replicate_sums(t, [ret], id_col, ["_era"], STRATEGY_BOOT, 42))
    whole = sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "hi0", "lo0")])
    of_era = resample.interval(resample.means_of(sums.filter(F.col("b") < ERA_BOOT), ["_era"]), ["_era"])
    era_stats = t.groupBy("_era").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.avg((r > 0).cast("double")).alias("win_rate"))
    eras = era_stats.join(of_era.select("_era", "ci_lo", "ci_hi"), "_era")
    one = metrics.one_sample_t(t, ret)
    tested = one.withColumn("ttest_p_value", metrics.t_p_value("t_stat", "df")).select(F.col("mean").alias("observed_mean"), "t_stat", "ttest_p_value")
    blocks = resample.interval(resample.block_bootstrap(t, ret, year, BLOCK_BOOT))
    loo = trades.leave_one_out(t, ret).agg(F.min("mean_without").alias("loo_worst_mean"), F.max("mean_without").alias("loo_best_mean"))
    parts = [
        t.agg(F.count(r).alias("n_trades"), F.count_distinct(year).alias("n_years")), tested,
        _renamed(resample.interval(resample.means_of(whole, [])), "bootstrap_"), resample.sign_permutation(t, ret, id_col, PERMUTATIONS),
        _renamed(blocks, "block_"), loo, metrics.winsorized_means(t, ret, CAPS),
        metrics.trimmed_mean(t, ret, id_col, TRIM).select(F.col("trimmed_mean").alias("trimmed_mean_10pct")),
    ]
    out = _named(eras.select("_era", "n", "mean", "win_rate", "ci_lo", "ci_hi"), F.concat(F.lit("era_"), F.col("_era"), F.lit("_")))
    for part in parts:
        out = out.unionByName(_named(part))
    return out


def _renamed(ci: DataFrame, prefix: str) -> DataFrame:
    return ci.select(*[F.col(c).alias(prefix + c) for c in ("ci_lo", "ci_hi", "p_positive")])
