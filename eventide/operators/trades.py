"""Signals, sides, costs, strategy grids and trade-level summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators.ordered import numbered, percent_ranks, quantiles, running

# Baseline short rules, strategies and grid of the study.
SLIPPAGE_GRID = (0.0, 25.0, 50.0, 75.0, 100.0)
TOP_K = (1, 3, 5)
MIN_EXPECTED = (0.05, 0.10, 0.15)
DEFAULT_BPS = 25.0


def percentile_signals(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Average-tie percentile inside each group and the signal it maps to."""
    ranked = percent_ranks(df, group, value, "expected_car_pct")
    return ranked.withColumn("trade_signal", sc.percentile_signal(F.col("expected_car_pct")))


def top_fraction(
    df: DataFrame, score: str, fraction: float, group: Sequence[str] = ("test_year",), id_col: str = "catalyst_id"
) -> DataFrame:
    """The best max(1, ceil(n·f)) scored rows of each group; ties go to the smaller id."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    if score not in df.columns:
        raise KeyError(f"missing score column: {score}")
    present = [g for g in group if g in df.columns]
    valid = df.filter(F.col(score).isNotNull())
    ranked = numbered(valid, present, [F.col(score).desc(), F.col(id_col).asc()], "_no", totals=True)
    n_select = F.greatest(F.lit(1), F.ceil(F.col("_no_total") * F.lit(float(fraction))))
    return ranked.filter(F.col("_no") <= n_select).drop("_no", "_no_total")


def extremes(df: DataFrame, value: str, k: int, group: str, id_col: str) -> DataFrame:
    """Rows among the k smallest or largest of their group with both positions. k is small, so each
    ranking is cut before its shuffle."""
    v = F.col(value)
    out = None
    for name, order in (("short_no", v.asc()), ("long_no", v.desc())):
        w = Window.partitionBy(group).orderBy(order, F.col(id_col).asc())
        part = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).select(id_col, name)
        out = part if out is None else out.join(part, id_col, "full")
    return df.join(out, id_col)


def top_k_sides(df: DataFrame, value: str, ks: Sequence[int] = TOP_K, group: str = "test_year",
                id_col: str = "catalyst_id") -> DataFrame:
    """Long the k largest and short the k smallest per group, for each k; both at once means short."""
    ends = extremes(df, value, max(ks), group, id_col)
    each = ends.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    side = F.when(F.col("short_no") <= F.col("k"), -1).when(F.col("long_no") <= F.col("k"), 1)
    return each.withColumn("side", side).filter("side is not null").drop("short_no", "long_no")


def with_costs(traded: DataFrame, bps: Column) -> DataFrame:
    """Gross, cost and net return of each traded side."""
    gross = F.col("side") * F.col("realized_car")
    return traded.withColumns(
        {"gross_return": gross, "slippage_cost": sc.slippage_cost(bps), "net_return": gross - sc.slippage_cost(bps)}
    )


def trade_ledger(ledger: DataFrame, bps: float = DEFAULT_BPS, fallback: bool = False) -> DataFrame:
    """Explicit signals become trades; the ±0.03 fallback is off unless asked for."""
    side = sc.side_of(F.col("trade_signal"), F.col("expected_car_adj") if fallback else None)
    return with_costs(ledger.withColumn("side", side).filter("side <> 0"), F.lit(bps))


def summarize_trades(trades: DataFrame, group: Sequence[str] = (), ret: str = "net_return") -> DataFrame:
    """Counts, win rate, mean, exact median, sum, mean/deviation and mean by side."""
    r = F.col(ret)
    sd = F.stddev_samp(r)
    stats = trades.groupBy(*group).agg(
        F.count(r).alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("mean_return"),
        F.sum(r).alias("total_return"),
        F.when(sd > 0, F.avg(r) / sd).alias("sharpe_approx"),
        F.avg(F.when(F.col("side") == 1, r)).alias("long_mean"),
        F.avg(F.when(F.col("side") == -1, r)).alias("short_mean"),
    )
    med = quantiles(trades, group, ret, {"median_return": 0.5}).drop("n_values")
    return stats.join(med, list(group)) if group else stats.withColumn(
        "median_return", med.select("median_return").scalar())


def slippage_grid(traded: DataFrame, grid: Sequence[float] = SLIPPAGE_GRID) -> DataFrame:
    """Every trade under every cost level; rows expand in place, nothing is joined."""
    each = traded.withColumn("slippage_bps", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    return with_costs(each, F.col("slippage_bps"))


def strategy_grid(ledger: DataFrame, bps: float = DEFAULT_BPS) -> DataFrame:
    """Trades of the walk-forward signals, the top-k family and the threshold family, stacked."""
    cols = ["catalyst_id", "test_year", "realized_car", "side", "strategy", "param"]
    base = ledger.withColumn("side", sc.side_of(F.col("trade_signal"))).withColumns(
        {"strategy": F.lit("walkforward_threshold"), "param": F.lit("default")})
    top = top_k_sides(ledger, "expected_car_adj").withColumns(
        {"strategy": F.lit("long_top_k"), "param": F.concat(F.lit("k="), F.col("k").cast("string"))})
    levels = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f"min={m:.0%}").alias("param")) for m in MIN_EXPECTED])
    thr = ledger.withColumn("_l", F.explode(levels)).withColumns(
        {"side": sc.threshold_side(F.col("expected_car_adj"), F.col("_l.m")), "strategy": F.lit("threshold"),
         "param": F.col("_l.param")})
    stacked = base.select(*cols).unionByName(top.select(*cols)).unionByName(thr.select(*cols))
    return with_costs(stacked.filter("side <> 0"), F.lit(bps))


def baseline_rules() -> dict[str, Column]:
    """Rule name → condition for going short; the random rule is handled by `random_fifth`."""
    one = lambda c: F.col(c) == 1
    return {
        "short_all_catalysts": F.lit(True),
        "short_phase_2": one("phase_2"),
        "short_phase_3": one("phase_3"),
        "short_small_cap": one("is_small_cap"),
        "short_high_dependency": one("high_dependency"),
        "short_high_volatility": one("high_volatility"),
        "short_negative_momentum": F.coalesce("pre_catalyst_runup_60d", F.lit(0.0)) < 0,
    }


def random_fifth(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """max(1, n // 5) rows without replacement, ordered by a seeded hash of the id."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))))
    ranked = numbered(keyed, [], ["_h", id_col], "_no", totals=True)
    return ranked.filter(F.col("_no") <= F.greatest(F.lit(1), F.floor(F.col("_no_total") / 5))).drop(
        "_no", "_no_total", "_h")


def baseline_trades(df: DataFrame, seed: int = 42, bps: float = DEFAULT_BPS) -> DataFrame:
    """Short trades of all eight baseline rules, stacked with their rule name."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in baseline_rules().items()]))
    ruled = df.withColumn("baseline", F.explode(hits))
    rnd = random_fifth(df, "catalyst_id", seed).withColumn("baseline", F.lit("random_short"))
    return ruled.unionByName(rnd).withColumn("short_return", sc.short_return(F.col("realized_car"), bps))


def evaluate_shorts(trades: DataFrame, label: str, ret: str) -> DataFrame:
    """n, mean, exact median, win rate and major-drop hit rates per label."""
    r, car = F.col(ret), F.col("realized_car")
    share = lambda c: F.avg(c.cast("double"))
    stats = trades.groupBy(label).agg(
        F.count(r).alias("n_trades"),
        F.avg(r).alias("mean_short_return"),
        share(r > 0).alias("win_rate"),
        share(car <= -0.10).alias("hit_rate_car_below_10pct"),
        share(car <= -0.20).alias("hit_rate_car_below_20pct"),
        F.avg(F.col("major_negative_event").cast("double")).alias("precision_major_drop"),
    )
    med = quantiles(trades, [label], ret, {"median_short_return": 0.5}).drop("n_values")
    return stats.join(med, label)


def model_strategies(preds: DataFrame, score: str) -> DataFrame:
    """Trades of the five predefined model strategies, stacked."""
    s = F.col(score)
    frames = [
        top_fraction(preds, score, f).withColumn("strategy", F.lit(f"short_top_{int(f * 100)}pct"))
        for f in (0.10, 0.20)
    ]
    frames += [
        preds.filter(s >= m).withColumn("strategy", F.lit(f"min_esr_{int(m * 100)}pct")) for m in (0.10, 0.20)
    ]
    frames.append(
        preds.filter(F.col("p_major_drop") >= F.col("major_drop_threshold")).withColumn(
            "strategy", F.lit("major_drop_threshold"))
    )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def strata(df: DataFrame) -> DataFrame:
    """Six bucketings per row, one output row per (row, stratification)."""
    on = lambda c: F.col(c) == 1
    pairs = {
        "small_cap_vs_large_cap": F.when(on("is_small_cap"), "small_cap").otherwise("large_or_mid"),
        "lead_vs_diversified": F.when(on("high_dependency"), "high_dependency").otherwise("low_dependency"),
        "phase_2_vs_phase_3": F.when(on("phase_3"), "phase_3").when(on("phase_2"), "phase_2").otherwise("other"),
        "momentum_positive_vs_negative": F.when(on("high_momentum"), "positive_momentum").otherwise("negative_or_flat"),
        "high_vs_low_volatility": F.when(on("high_volatility"), "high_vol").otherwise("low_vol"),
        "oncology_vs_other": F.when(
            F.coalesce(F.col("indication").rlike(sc.ONCOLOGY), F.lit(False)), "oncology_like").otherwise("other"),
    }
    arr = F.array(*[F.struct(F.lit(n).alias("stratification"), c.alias("bucket")) for n, c in pairs.items()])
    return df.withColumn("_s", F.explode(arr)).select("*", "_s.stratification", "_s.bucket").drop("_s")


def stratified(df: DataFrame, bps: float = DEFAULT_BPS) -> DataFrame:
    """Failure rate, mean CAR by outcome and mean short return per bucket of at least three rows."""
    car = F.col("realized_car")
    return (
        strata(df)
        .groupBy("stratification", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("clinical_failure").alias("failure_rate"),
            F.avg(F.when(F.col("clinical_failure") == 0, car)).alias("success_mean_car"),
            F.avg(F.when(F.col("clinical_failure") == 1, car)).alias("failure_mean_car"),
            F.avg(sc.short_return(car, bps)).alias("short_all_mean_return"),
        )
        .filter("n >= 3")
    )


def era(year: Column) -> Column:
    return (
        F.when(year <= 2016, "early_2010_2016").when(year <= 2020, "middle_2017_2020").otherwise("late_2021_plus")
    )


def leave_one_out(trades: DataFrame, ret: str) -> DataFrame:
    """Mean without each trade and its change, from the overall sum and count."""
    total = trades.agg(F.sum(ret)).scalar()
    n = trades.agg(F.count(ret)).scalar()
    without = F.try_divide(total - F.col(ret), n - 1)
    return trades.withColumns({"mean_without": without, "delta_mean": without - total / n})


def equity_path(
    trades: DataFrame, start: float = 100_000.0, position: float = 0.02, bps: float = DEFAULT_BPS,
    max_exposure: float = 0.20, date: str = "announcement_date", id_col: str = "catalyst_id",
) -> DataFrame:
    """Capital after each short trade in (date, id) order, its return and the running peak.

    Positions close before the next opens, so the notional is constant and capital is a running sum.
    """
    notional = start * min(position, max_exposure)
    pnl = -F.col("realized_car") * notional - F.lit(notional * 2 * bps / 10000.0)
    rows = trades.select(id_col, date, pnl.alias("pnl"))
    summed = running(rows, [], [date, id_col], sums={"cum_pnl": "pnl"})
    cap = F.lit(start) + F.col("cum_pnl")
    path = summed.withColumns({"capital_after": cap, "ret": F.try_divide(F.col("pnl"), cap - F.col("pnl"))})
    peaked = running(path, [], [date, id_col], maxes={"peak_after": "capital_after"})
    return peaked.withColumn("peak", F.greatest("peak_after", F.lit(start))).drop("peak_after")


def portfolio_summary(path: DataFrame, start: float = 100_000.0, date: str = "announcement_date") -> DataFrame:
    """Total return, population volatility, trades per year, Sharpe, Sortino and deepest drawdown."""
    down = F.when(F.col("ret") < 0, F.col("ret"))
    s = path.agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("pnl").alias("pnl"),
        F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("vol"),
        F.stddev_pop(down).alias("down_vol"),
        F.count(down).alias("n_down"),
        F.datediff(F.max(date), F.min(date)).alias("days"),
        F.min((F.col("capital_after") - F.col("peak")) / F.col("peak")).alias("dd"),
    )
    per_year = F.col("n_trades") / F.greatest(F.col("days") / 365.25, F.lit(1.0))
    scale = F.sqrt(per_year)
    return s.select(
        "n_trades",
        (F.col("pnl") / start).alias("total_return"),
        F.col("vol").alias("volatility"),
        per_year.alias("trades_per_year"),
        F.when(F.col("vol") > 0, F.col("mean") / F.col("vol") * scale).alias("sharpe"),
        F.when((F.col("n_down") > 1) & (F.col("down_vol") > 0), F.col("mean") / F.col("down_vol") * scale).alias("sortino"),
        F.least(F.col("dd"), F.lit(0.0)).alias("max_drawdown"),
    )


def verdict(c: dict[str, Column]) -> Column:
    """Label from the eight checks (boolean columns by name)."""
    n_pass = sum((x.cast("int") for x in c.values()), F.lit(0))
    return (
        F.when((n_pass >= 7) & c["min_trades"] & c["positive_mean"] & c["beats_dependency"], "ROBUST OOS EDGE")
        .when(
            (n_pass >= 5) & c["positive_mean"] & c["beats_short_all"] & c["beats_dependency"],
            "PROMISING BUT UNVALIDATED EDGE",
        )
        .when(c["positive_mean"], "WEAK / INCONCLUSIVE EDGE")
        .otherwise("NO EVIDENCE OF SHORT EDGE")
    )
