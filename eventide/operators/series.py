"""Daily price series: bars, returns, alignment and trailing features.

Everything ordered runs on one row per (ticker, date), so the calendar bounds each window group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAILING_DAYS = (1, 5, 20, 60, 120)


def _by_date(key: str = "ticker") -> Window:
    return Window.partitionBy(key).orderBy("date")


def simple_returns(bars: DataFrame, key: str = "ticker", price: str = "adj_close") -> DataFrame:
    """(key, date, ret): price over previous price − 1 on the series' own calendar, first row dropped.

    A missing price inside the series repeats the last known one.
    """
    w = _by_date(key)
    padded = bars.withColumn(
        "_px",
        F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
    ret = F.try_divide(F.col("_px"), F.lag("_px").over(w)) - F.lit(1.0)
    return padded.select(key, "date", ret.alias("ret")).filter(F.col("ret").isNotNull())


def benchmark_returns(bench: DataFrame) -> DataFrame:
    """Wide (date, spy, xbi) from a long (benchmark, date, adj_close) table; one row per day."""
    rets = simple_returns(bench, key="benchmark")
    return (
        rets.groupBy("date")
        .agg(
            F.max(F.when(F.col("benchmark") == "SPY", F.col("ret"))).alias("spy"),
            F.max(F.when(F.col("benchmark") == "XBI", F.col("ret"))).alias("xbi"),
        )
    )


def align(returns: DataFrame, bench_wide: DataFrame) -> DataFrame:
    """Inner join on date; rows with any missing return are dropped. The daily table is small by
    construction (one row per calendar day), which is what makes the broadcast safe."""
    daily = bench_wide.filter(F.col("spy").isNotNull() & F.col("xbi").isNotNull())
    return returns.join(F.broadcast(daily), "date")


def trailing_features(bars: DataFrame, bench_wide: DataFrame) -> DataFrame:
    """Per (ticker, date): the features known once that session has closed.

    Requires at least 30 sessions up to and including the row; a row describes every cutoff that
    falls after its date and on or before the ticker's next session.
    """
    w = _by_date()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    px = F.col("adj_close")
    n = F.row_number().over(w)
    high = F.max(px).over(w.rowsBetween(-251, 0))
    ret = F.try_divide(px, F.lag(px).over(w)) - 1
    base = bars.withColumns({"n_bars": n, "ret": ret, "high_52w": high})
    vol20 = F.when(
        F.col("n_bars") >= 21, F.stddev_samp("ret").over(w.rowsBetween(-19, 0)) * F.sqrt(F.lit(252.0))
    )
    recent = F.avg("volume").over(w.rowsBetween(-4, 0))
    base_long = F.avg("volume").over(w.rowsBetween(-59, -5))
    base_all = F.avg("volume").over(w.rowsBetween(Window.unboundedPreceding, -5))
    vol_base = F.when(F.col("n_bars") >= 60, base_long).otherwise(base_all)
    own = base.withColumns(
        {
            **{f"return_{k}d": F.try_divide(px, F.lag(px, k).over(w)) - 1 for k in TRAILING_DAYS},
            "realized_vol_20d": vol20,
            "distance_from_52w_high": F.when(F.col("high_52w") > 0, px / F.col("high_52w") - 1),
            "volume_ratio_20d": F.when(
                (F.col("n_bars") >= 20) & (vol_base > 0), recent / vol_base
            ),
        }
    )
    abn = abnormal_trailing(own.filter(F.col("ret").isNotNull()).select("ticker", "date", "ret"),
                            bench_wide)
    joined = own.join(abn, ["ticker", "date"], "left")
    # A session the benchmark lacks keeps the abnormal return of the last common session.
    filled = {
        c: F.last(F.col(c), ignorenulls=True).over(upto).getField("v")
        for c in ("abnormal_return_20d_xbi", "abnormal_return_60d_xbi")
    }
    return (
        joined.withColumns(filled)
        .withColumn("pre_catalyst_runup_60d", F.col("return_60d"))
        .withColumnRenamed("adj_close", "price_at_cutoff")
        .filter(F.col("n_bars") >= 30)
    )


def abnormal_trailing(returns: DataFrame, bench_wide: DataFrame) -> DataFrame:
    """Trailing 20 and 60 day return minus the benchmark's, on common sessions only (≥ 25 of them)."""
    xbi = bench_wide.filter(F.col("xbi").isNotNull()).select("date", "xbi")
    common = returns.join(F.broadcast(xbi), "date")
    w = _by_date()

    def compounded(c: str, k: int) -> Column:
        return F.product(F.lit(1.0) + F.col(c)).over(w.rowsBetween(-(k - 1), 0)) - 1

    n = F.row_number().over(w)
    numbered = common.withColumn("_n", n)

    def gap(k: int) -> Column:
        v = F.when(
            (F.col("_n") >= 25) & (F.col("_n") >= k), compounded("ret", k) - compounded("xbi", k)
        )
        return F.struct(v.alias("v"))

    return numbered.select(
        "ticker",
        "date",
        gap(20).alias("abnormal_return_20d_xbi"),
        gap(60).alias("abnormal_return_60d_xbi"),
    )
