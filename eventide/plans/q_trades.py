"""Queries: ranking signals, sides, costs, grids, baselines, portfolio and verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.functions.rounding import rnd
from eventide.operators import cutoffs, metrics, resample, trades
from eventide.operators.ordered import numbered
from eventide.plans import inputs
from eventide.plans.oracle_base import LEDGER, POISSON_CDF, SHORT, SIGNALS, boot, draw, r
from eventide.plans.q_features import _RISK, risk_frame
from eventide.session import stable

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def signal_ledger(spark, sf):
    led = inputs.ledger(spark, sf).withColumn("expected_car_adj", F.col("expected_car"))
    return trades.percentile_signals(led, "expected_car_adj", ["test_year"])


def traded_ledger(spark, sf):
    return stable(trades.trade_ledger(signal_ledger(spark, sf)))


def short_preds(spark, sf):
    car, year = F.col("realized_car"), F.col("test_year")
    return inputs.ledger(spark, sf).withColumns({
        "net_expected_short_return": sc.short_return(F.col("expected_car")),
        "realized_short_return": sc.short_return(car),
        "p_major_drop": F.col("p_failure"),
        "major_drop_threshold": F.lit(0.35) + (year % 5) * 0.1,
        "clinical_failure": F.coalesce(F.col("clinical_success") == 0, F.lit(False)).cast("int"),
        "major_negative_event": (car <= -0.20).cast("int"),
    })


def primary_trades(spark, sf):
    """The primary strategy: the top fifth of each year by net expected short return."""
    return stable(trades.top_fraction(short_preds(spark, sf), "net_expected_short_return", 0.20))


_SUM_COLS = ("win_rate", "mean_return", "median_return", "total_return", "sharpe_approx", "long_mean", "short_mean")


def _summary_sql(ret="net_return"):
    return f"""count(*) AS n_trades, {r(f'avg(CASE WHEN {ret} > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate,
  {r(f'avg({ret})')} AS mean_return, {r(f'quantile_cont({ret}, 0.5)')} AS median_return, {r(f'sum({ret})', 4)} AS total_return,
  {r(f'avg({ret}) / stddev_samp({ret})')} AS sharpe_approx, {r(f'avg({ret}) FILTER (WHERE side = 1)')} AS long_mean,
  {r(f'avg({ret}) FILTER (WHERE side = -1)')} AS short_mean"""


def _summary(df):
    return df.withColumns({c: rnd(c, 4 if c == "total_return" else 6) for c in _SUM_COLS})


@register("percentile_signals", f"""WITH {SIGNALS} SELECT catalyst_id, test_year, {r('expected_car_pct', 9)} AS expected_car_pct,
  trade_signal FROM sig""")
def percentile_signals(spark, sf):
    return signal_ledger(spark, sf).select("catalyst_id", "test_year", rnd("expected_car_pct", 9).alias("expected_car_pct"),
                                           "trade_signal")


@register("fixed_signals", f"""WITH {LEDGER} SELECT catalyst_id, CASE WHEN expected_car > 0.05::DOUBLE THEN 'STRONG LONG'
  WHEN expected_car > 0.03::DOUBLE THEN 'LONG' WHEN expected_car < (-0.05)::DOUBLE THEN 'STRONG SHORT'
  WHEN expected_car < (-0.03)::DOUBLE THEN 'SHORT' ELSE 'NO_TRADE' END AS signal FROM ledger""")
def fixed_signals(spark, sf):
    return inputs.ledger(spark, sf).select("catalyst_id", sc.fixed_signal(F.col("expected_car")).alias("signal"))


@register("trade_sides", f"""WITH {SIGNALS} SELECT catalyst_id, side,
  CASE WHEN side <> 0 THEN side WHEN expected_car > 0.03::DOUBLE THEN 1 WHEN expected_car < (-0.03)::DOUBLE THEN -1
    ELSE 0 END AS side_with_fallback,
  CASE WHEN expected_car <= (-0.05)::DOUBLE THEN -1 WHEN expected_car >= 0.05::DOUBLE THEN 1 ELSE 0 END AS threshold_side
FROM sided""")
def trade_sides(spark, sf):
    sig, exp = F.col("trade_signal"), F.col("expected_car_adj")
    return signal_ledger(spark, sf).select(
        "catalyst_id", sc.side_of(sig).alias("side"), sc.side_of(sig, exp).alias("side_with_fallback"),
        sc.threshold_side(exp, F.lit(0.05)).alias("threshold_side"))


@register("trade_costs", f"""WITH {SIGNALS} SELECT catalyst_id, test_year, side, {r('gross_return', 9)} AS gross_return,
  0.005::DOUBLE AS slippage_cost, {r('net_return', 9)} AS net_return FROM traded ORDER BY test_year, net_return DESC""")
def trade_costs(spark, sf):
    t = trades.trade_ledger(signal_ledger(spark, sf))
    return t.select("catalyst_id", "test_year", "side", rnd("gross_return", 9).alias("gross_return"),
                    rnd("slippage_cost", 9).alias("slippage_cost"), rnd("net_return", 9).alias("net_return")
                    ).orderBy("test_year", F.col("net_return").desc())


@register("ledger_enrichment", f"""WITH {LEDGER} SELECT l.catalyst_id, l.ticker, l.drug_name, l.indication,
  {r('l.expected_car', 9)} AS expected_car_adj, l.company_dependency FROM ledger l""")
def ledger_enrichment(spark, sf):
    led = inputs.ledger(spark, sf)
    ev = inputs.catalysts(spark, sf).select("catalyst_id", "ticker", "drug_name", "indication")
    core = led.select("catalyst_id", F.col("expected_car").alias("expected_car_adj"))
    expo = led.filter("company_dependency is not null").select("catalyst_id", "company_dependency")
    out = core.join(ev, "catalyst_id").join(expo, "catalyst_id", "left")
    return out.withColumn("expected_car_adj", rnd("expected_car_adj", 9))


@register("topk_sides", f"""WITH {LEDGER}, k AS (SELECT unnest([1, 3, 5]) AS k), x AS (SELECT catalyst_id, test_year,
    row_number() OVER (PARTITION BY test_year ORDER BY expected_car, catalyst_id) AS s,
    row_number() OVER (PARTITION BY test_year ORDER BY expected_car DESC, catalyst_id) AS l FROM ledger)
SELECT catalyst_id, test_year, k, CASE WHEN s <= k THEN -1 ELSE 1 END AS side FROM x, k WHERE s <= k OR l <= k""")
def topk_sides(spark, sf):
    return trades.top_k_sides(inputs.ledger(spark, sf), "expected_car").select("catalyst_id", "test_year", "k", "side")


@register("top_fraction", f"WITH {SHORT} SELECT catalyst_id, test_year, {r('nesr', 9)} AS score FROM top20")
def top_fraction(spark, sf):
    t = trades.top_fraction(short_preds(spark, sf), "net_expected_short_return", 0.20)
    return t.select("catalyst_id", "test_year", rnd("net_expected_short_return", 9).alias("score"))


@register("top_fraction_global", f"""WITH {SHORT} SELECT catalyst_id FROM (SELECT catalyst_id,
  row_number() OVER (ORDER BY nesr DESC, catalyst_id) AS rn, count(*) OVER () AS n FROM short) WHERE rn <= ceil(n * 0.1::DOUBLE)""")
def top_fraction_global(spark, sf):
    return trades.top_fraction(short_preds(spark, sf), "net_expected_short_return", 0.10, group=()).select("catalyst_id")


@register("ranking", f"""WITH {LEDGER}, a AS (SELECT *, expected_car * coalesce(company_dependency, 0.9::DOUBLE) AS adj FROM ledger)
SELECT catalyst_id, ticker, row_number() OVER (ORDER BY adj DESC, catalyst_id) AS rank, {r('adj', 9)} AS expected_car_exposure_adj
FROM a""")
def ranking(spark, sf):
    dep = F.coalesce("company_dependency", F.lit(0.9))
    led = inputs.ledger(spark, sf).withColumn("adj", F.col("expected_car") * dep)
    ranked = numbered(led, [], [F.col("adj").desc(), F.col("catalyst_id").asc()], "rank")
    return ranked.select("catalyst_id", "ticker", "rank", rnd("adj", 9).alias("expected_car_exposure_adj"))


@register("backtest_summary", f"""WITH {SIGNALS}, {boot('traded', 'net_return', 'catalyst_id')},
ci AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot)
SELECT {_summary_sql()}, {r('any_value(lo)')} AS ci_lo, {r('any_value(hi)')} AS ci_hi FROM traded, ci""")
def backtest_summary(spark, sf):
    t = traded_ledger(spark, sf)
    ci = stable(resample.interval(resample.bootstrap_means(t, "net_return", "catalyst_id")))
    s = _summary(trades.summarize_trades(t))
    return s.withColumns({"ci_lo": rnd(ci.select("ci_lo").scalar()), "ci_hi": rnd(ci.select("ci_hi").scalar())})


@register("walk_forward_summary", f"""WITH {SIGNALS} SELECT count(*) AS n, {r('corr(expected_car, realized_car)')} AS corr,
  {r('avg(realized_car) FILTER (WHERE side = 1)')} AS long_mean, {r('avg(realized_car) FILTER (WHERE side = -1)')} AS short_mean,
  count(*) FILTER (WHERE side = 1) AS n_long, count(*) FILTER (WHERE side = -1) AS n_short FROM sided""")
def walk_forward_summary(spark, sf):
    led = signal_ledger(spark, sf).withColumn("side", sc.side_of(F.col("trade_signal")))
    car = F.col("realized_car")
    s = led.agg(
        F.count(F.lit(1)).alias("n"), metrics.correlation("expected_car", "realized_car").alias("corr"),
        F.avg(F.when(F.col("side") == 1, car)).alias("long_mean"),
        F.avg(F.when(F.col("side") == -1, car)).alias("short_mean"),
        F.count(F.when(F.col("side") == 1, 1)).alias("n_long"), F.count(F.when(F.col("side") == -1, 1)).alias("n_short"))
    return s.withColumns({c: rnd(c) for c in ("corr", "long_mean", "short_mean")})


_HOLD = LEDGER + """,
hold AS (SELECT * FROM ledger WHERE test_year BETWEEN 1999 AND 2000)"""


@register("holdout_summary", f"""WITH {_HOLD},
u AS (SELECT expected_car AS x, realized_car AS y, b, {draw(42, 'b', 'catalyst_id')} / 2147483647e0 AS u
    FROM hold, (SELECT unnest(range(500)) AS b)),
w AS (SELECT b, x, y, {' + '.join(f'CAST(u >= {c!r}::DOUBLE AS INTEGER)' for c in POISSON_CDF)} AS w FROM u),
t AS (SELECT b, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy
    FROM w GROUP BY 1),
c AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS c FROM t
    WHERE n >= 3 AND n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12)
SELECT count(*) AS n, {r('corr(expected_car, realized_car)')} AS corr,
  {r('(SELECT quantile_cont(c, 0.025) FROM c)', 5)} AS corr_lo, {r('(SELECT quantile_cont(c, 0.975) FROM c)', 5)} AS corr_hi,
  count(*) FILTER (WHERE expected_car > 0.03::DOUBLE) AS n_long, count(*) FILTER (WHERE expected_car < (-0.03)::DOUBLE) AS n_short,
  {r('avg(realized_car) FILTER (WHERE expected_car > 0.03::DOUBLE)')} AS long_mean,
  {r('avg(realized_car) FILTER (WHERE expected_car < (-0.03)::DOUBLE)')} AS short_mean FROM hold""")
def holdout_summary(spark, sf):
    led = inputs.ledger(spark, sf)
    hold = stable(led.filter(cutoffs.holdout_split(F.col("test_year"), 1999, 2000) == "test"))
    ci = stable(resample.interval(resample.bootstrap_correlations(hold, "expected_car", "realized_car", "catalyst_id")))
    e, car = F.col("expected_car"), F.col("realized_car")
    s = hold.agg(
        F.count(F.lit(1)).alias("n"), rnd(metrics.correlation(e, car)).alias("corr"),
        F.count(F.when(e > 0.03, 1)).alias("n_long"), F.count(F.when(e < -0.03, 1)).alias("n_short"),
        rnd(F.avg(F.when(e > 0.03, car))).alias("long_mean"), rnd(F.avg(F.when(e < -0.03, car))).alias("short_mean"))
    return s.withColumns({"corr_lo": rnd(ci.select("ci_lo").scalar(), 5), "corr_hi": rnd(ci.select("ci_hi").scalar(), 5)})


@register("slippage_grid", f"""WITH {SIGNALS}, g AS (SELECT *, gross_return - 2e0 * (bps / 10000e0) AS net FROM traded,
  (SELECT unnest([0e0, 25e0, 50e0, 75e0, 100e0]) AS bps))
SELECT bps AS slippage_bps, {_summary_sql('net')} FROM g GROUP BY 1""")
def slippage_grid(spark, sf):
    t = traded_ledger(spark, sf).drop("gross_return", "slippage_cost", "net_return")
    return _summary(trades.summarize_trades(trades.slippage_grid(t), ["slippage_bps"]))


@register("strategy_grid", f"""WITH {SIGNALS}, x AS (SELECT catalyst_id, test_year, realized_car,
    row_number() OVER (PARTITION BY test_year ORDER BY expected_car, catalyst_id) AS s,
    row_number() OVER (PARTITION BY test_year ORDER BY expected_car DESC, catalyst_id) AS l FROM ledger),
a AS (SELECT realized_car, side, 'walkforward_threshold' AS strategy, 'default' AS param FROM sided
  UNION ALL SELECT realized_car, CASE WHEN s <= k THEN -1 ELSE 1 END, 'long_top_k', 'k=' || k FROM x,
    (SELECT unnest([1, 3, 5]) AS k) WHERE s <= k OR l <= k
  UNION ALL SELECT realized_car, CASE WHEN expected_car <= -m THEN -1 WHEN expected_car >= m THEN 1 ELSE 0 END, 'threshold',
    'min=' || CAST(round(m * 100) AS INTEGER) || '%' FROM ledger, (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE, 0.15::DOUBLE]) AS m)),
n AS (SELECT *, side * realized_car - 0.005::DOUBLE AS net FROM a WHERE side <> 0)
SELECT strategy, param, {_summary_sql('net')} FROM n GROUP BY 1, 2""")
def strategy_grid(spark, sf):
    t = stable(trades.strategy_grid(stable(signal_ledger(spark, sf))))
    return _summary(trades.summarize_trades(t, ["strategy", "param"]))


_EVAL = f"""count(*) AS n_trades, {r('avg(ret)')} AS mean_short_return, {r('quantile_cont(ret, 0.5)')} AS median_short_return,
  {r('avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate,
  {r('avg(CASE WHEN realized_car <= (-0.10)::DOUBLE THEN 1e0 ELSE 0e0 END)')} AS hit_rate_car_below_10pct,
  {r('avg(CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1e0 ELSE 0e0 END)')} AS hit_rate_car_below_20pct,
  {r('avg(CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1e0 ELSE 0e0 END)')} AS precision_major_drop"""
_EVAL_COLS = ("mean_short_return", "median_short_return", "win_rate", "hit_rate_car_below_10pct",
              "hit_rate_car_below_20pct", "precision_major_drop")
_COST = "2e0 * (25e0 / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0)"


@register("baseline_rules", f"""WITH {_RISK}, rules AS (SELECT unnest(['short_all_catalysts', 'short_phase_2', 'short_phase_3',
    'short_small_cap', 'short_high_dependency', 'short_high_volatility', 'short_negative_momentum']) AS baseline),
hash AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || catalyst_id), catalyst_id) AS h, count(*) OVER () AS n FROM risk),
t AS (SELECT baseline, realized_car, -realized_car - {_COST} AS ret FROM risk, rules WHERE CASE baseline
    WHEN 'short_all_catalysts' THEN true WHEN 'short_phase_2' THEN phase_2 = 1 WHEN 'short_phase_3' THEN phase_3 = 1
    WHEN 'short_small_cap' THEN is_small_cap = 1 WHEN 'short_high_dependency' THEN high_dependency = 1
    WHEN 'short_high_volatility' THEN high_volatility = 1 ELSE coalesce(pre_catalyst_runup_60d, 0) < 0 END
  UNION ALL SELECT 'random_short', realized_car, -realized_car - {_COST} FROM hash WHERE h <= greatest(1, n // 5))
SELECT baseline, {_EVAL} FROM t GROUP BY 1""")
def baseline_rules(spark, sf):
    t = stable(trades.baseline_trades(stable(risk_frame(spark, sf))))
    return trades.evaluate_shorts(t, "baseline", "short_return").withColumns({c: rnd(c) for c in _EVAL_COLS})


@register("random_fifth", f"""WITH {LEDGER} SELECT catalyst_id FROM (SELECT catalyst_id, row_number() OVER (
  ORDER BY md5('42|' || catalyst_id), catalyst_id) AS h, count(*) OVER () AS n FROM ledger) WHERE h <= greatest(1, n // 5)""")
def random_fifth(spark, sf):
    return trades.random_fifth(inputs.ledger(spark, sf), "catalyst_id").select("catalyst_id")


@register("model_strategies", f"""WITH {SHORT}, t AS (SELECT 'short_top_20pct' AS strategy, rsr AS ret, realized_car FROM top20
  UNION ALL SELECT 'short_top_10pct', rsr, realized_car FROM top10
  UNION ALL SELECT 'min_esr_10pct', rsr, realized_car FROM short WHERE nesr >= 0.10::DOUBLE
  UNION ALL SELECT 'min_esr_20pct', rsr, realized_car FROM short WHERE nesr >= 0.20::DOUBLE
  UNION ALL SELECT 'major_drop_threshold', rsr, realized_car FROM short WHERE p_major_drop >= major_drop_threshold)
SELECT strategy, {_EVAL} FROM t GROUP BY 1""")
def model_strategies(spark, sf):
    t = stable(trades.model_strategies(short_preds(spark, sf), "net_expected_short_return"))
    return trades.evaluate_shorts(t, "strategy", "realized_short_return").withColumns({c: rnd(c) for c in _EVAL_COLS})


_STRATA = _RISK + """,
st AS (SELECT r.*, s.stratification, CASE s.stratification
    WHEN 'small_cap_vs_large_cap' THEN CASE WHEN is_small_cap = 1 THEN 'small_cap' ELSE 'large_or_mid' END
    WHEN 'lead_vs_diversified' THEN CASE WHEN high_dependency = 1 THEN 'high_dependency' ELSE 'low_dependency' END
    WHEN 'phase_2_vs_phase_3' THEN CASE WHEN phase_3 = 1 THEN 'phase_3' WHEN phase_2 = 1 THEN 'phase_2' ELSE 'other' END
    WHEN 'momentum_positive_vs_negative' THEN CASE WHEN high_momentum = 1 THEN 'positive_momentum' ELSE 'negative_or_flat' END
    WHEN 'high_vs_low_volatility' THEN CASE WHEN high_volatility = 1 THEN 'high_vol' ELSE 'low_vol' END
    ELSE CASE WHEN regexp_matches(indication, 'NSCLC|melanoma|breast|AML|DLBCL|RCC|ovarian|TNBC|lymphoma|myeloma|HCC|CLL', 'i')
      THEN 'oncology_like' ELSE 'other' END END AS bucket
  FROM risk r, (SELECT unnest(['small_cap_vs_large_cap', 'lead_vs_diversified', 'phase_2_vs_phase_3',
    'momentum_positive_vs_negative', 'high_vs_low_volatility', 'oncology_vs_other']) AS stratification) s)"""


@register("stratification", f"""WITH {_STRATA} SELECT stratification, bucket, count(*) AS n, {r('avg(clinical_failure)')} AS failure_rate,
  {r('avg(realized_car) FILTER (WHERE clinical_failure = 0)')} AS success_mean_car,
  {r('avg(realized_car) FILTER (WHERE clinical_failure = 1)')} AS failure_mean_car,
  {r(f'avg(-realized_car - {_COST})')} AS short_all_mean_return FROM st GROUP BY 1, 2 HAVING count(*) >= 3""")
def stratification(spark, sf):
    out = trades.stratified(risk_frame(spark, sf))
    return out.withColumns({c: rnd(c) for c in ("failure_rate", "success_mean_car", "failure_mean_car",
                                                "short_all_mean_return")})


_ERAS = "CASE WHEN test_year <= 1996 THEN 'early' WHEN test_year <= 1998 THEN 'middle' ELSE 'late' END"


def _era3(year):
    return F.when(year <= 1996, "early").when(year <= 1998, "middle").otherwise("late")


@register("era_split", f"""WITH {SHORT}, e AS (SELECT *, {_ERAS} AS era FROM top20), {boot('e', 'rsr', 'catalyst_id', group='era')},
ci AS (SELECT g AS era, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY 1)
SELECT era, count(*) AS n, {r('avg(rsr)')} AS mean_short_return, {r('avg(CASE WHEN rsr > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate,
  {r('any_value(lo)')} AS ci_lo, {r('any_value(hi)')} AS ci_hi FROM e JOIN ci USING (era) GROUP BY 1""")
def era_split(spark, sf):
    t = stable(primary_trades(spark, sf).withColumn("era", _era3(F.col("test_year"))))
    rsr = F.col("realized_short_return")
    s = t.groupBy("era").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(rsr)).alias("mean_short_return"),
                             rnd(F.avg((rsr > 0).cast("double"))).alias("win_rate"))
    ci = resample.interval(resample.bootstrap_means(t, "realized_short_return", "catalyst_id", ["era"]), ["era"])
    return s.join(ci.select("era", rnd("ci_lo").alias("ci_lo"), rnd("ci_hi").alias("ci_hi")), "era")


@register("era_labels", f"""WITH {LEDGER} SELECT CASE WHEN test_year + 16 <= 2016 THEN 'early_2010_2016' WHEN test_year + 16 <= 2020
  THEN 'middle_2017_2020' ELSE 'late_2021_plus' END AS era, count(*) AS n FROM ledger GROUP BY 1""")
def era_labels(spark, sf):
    return inputs.ledger(spark, sf).groupBy(trades.era(F.col("test_year") + 16).alias("era")).agg(
        F.count(F.lit(1)).alias("n"))


@register("slippage_stress", f"""WITH {SHORT} SELECT bps AS slippage_bps, count(*) AS n,
  {r('avg(-realized_car - 2e0 * (bps / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0))')} AS mean_short_return,
  {r('avg(CASE WHEN -realized_car - 2e0 * (bps / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0) > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate
FROM top20, (SELECT unnest([25e0, 50e0, 100e0, 200e0]) AS bps) GROUP BY 1""")
def slippage_stress(spark, sf):
    t = trades.top_fraction(short_preds(spark, sf), "net_expected_short_return", 0.20)
    each = t.withColumn("slippage_bps", F.explode(F.array(*[F.lit(b) for b in (25.0, 50.0, 100.0, 200.0)])))
    ret = sc.short_return(F.col("realized_car"), F.col("slippage_bps"))
    return each.groupBy("slippage_bps").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(ret)).alias("mean_short_return"),
                                            rnd(F.avg((ret > 0).cast("double"))).alias("win_rate"))


@register("loo_mean", f"""WITH {SHORT} SELECT catalyst_id, {r('(sum(rsr) OVER () - rsr) / (count(*) OVER () - 1)', 8)} AS mean_without,
  {r('(sum(rsr) OVER () - rsr) / (count(*) OVER () - 1) - avg(rsr) OVER ()', 8)} AS delta_mean FROM top20""")
def loo_mean(spark, sf):
    out = trades.leave_one_out(primary_trades(spark, sf), "realized_short_return")
    return out.select("catalyst_id", rnd("mean_without", 8).alias("mean_without"), rnd("delta_mean", 8).alias("delta_mean"))


_EQUITY = SHORT + """,
pnl AS (SELECT catalyst_id, announcement_date, -realized_car * 2000e0 - 10e0 AS pnl FROM top20),
cap AS (SELECT *, 100000e0 + sum(pnl) OVER w AS capital FROM pnl WINDOW w AS (ORDER BY announcement_date, catalyst_id)),
eq AS (SELECT *, pnl / (capital - pnl) AS ret, greatest(100000e0, max(capital) OVER (ORDER BY announcement_date, catalyst_id))
  AS peak FROM cap)"""


@register("equity_path", f"""WITH {_EQUITY} SELECT catalyst_id, {r('capital', 4)} AS capital_after, {r('ret', 8)} AS ret,
  {r('peak', 4)} AS peak FROM eq""")
def equity_path(spark, sf):
    p = trades.equity_path(primary_trades(spark, sf))
    return p.select("catalyst_id", rnd("capital_after", 4).alias("capital_after"), rnd("ret", 8).alias("ret"),
                    rnd("peak", 4).alias("peak"))


@register("portfolio_summary", f"""WITH {_EQUITY}, s AS (SELECT count(*) AS n, sum(pnl) AS pnl, avg(ret) AS m, stddev_pop(ret) AS v,
    stddev_pop(ret) FILTER (WHERE ret < 0) AS dv, max(announcement_date) - min(announcement_date) AS days,
    min((capital - peak) / peak) AS dd FROM eq),
z AS (SELECT *, n / greatest(days / 365.25::DOUBLE, 1e0) AS tpy FROM s)
SELECT n AS n_trades, {r('pnl / 100000e0')} AS total_return, {r('v', 8)} AS volatility, {r('tpy', 4)} AS trades_per_year,
  {r('m / v * sqrt(tpy)')} AS sharpe, {r('m / dv * sqrt(tpy)')} AS sortino, {r('least(dd, 0)')} AS max_drawdown FROM z""")
def portfolio_summary(spark, sf):
    s = trades.portfolio_summary(trades.equity_path(primary_trades(spark, sf)))
    places = {"volatility": 8, "trades_per_year": 4}
    return s.withColumns({c: rnd(c, places.get(c, 6)) for c in s.columns if c != "n_trades"})


@register("verdict", f"""WITH {SHORT},
yr AS (SELECT row_number() OVER (ORDER BY test_year) - 1 AS pos, count(*) OVER () AS n, sum(rsr) AS s, count(*) AS c
  FROM top20 GROUP BY test_year),
bd AS (SELECT b, n, pos AS i FROM yr, (SELECT unnest(range(2000)) AS b)),
bu AS (SELECT b, {draw(42, 'b', 'i')} % n AS pos FROM bd),
bb AS (SELECT b, sum(s) / sum(c) AS m FROM bu JOIN yr USING (pos) GROUP BY 1),
e AS (SELECT {_ERAS} AS era, avg(rsr) AS m FROM top20 GROUP BY 1),
k AS (SELECT (SELECT count(*) FROM top20) >= 50 AS min_trades, (SELECT avg(rsr) FROM top20) > 0 AS positive_mean,
  (SELECT quantile_cont(m, 0.025) FROM bb) > 0 AS ci_above_zero,
  (SELECT count(*) FROM e WHERE m > 0) >= 2 AS multi_era_positive,
  (SELECT avg(rsr) FROM top20) > (SELECT avg(rsr) FROM short) AS beats_short_all,
  (SELECT avg(rsr) FROM top20) > (SELECT avg(rsr) FROM short WHERE coalesce(company_dependency, 0.9::DOUBLE) >= 0.80::DOUBLE) AS beats_dependency,
  (SELECT avg(rsr - 2e0 * (75e0 / 10000e0)) FROM top20) > 0 AS survives_100bps,
  (SELECT (sum(rsr) - max(rsr)) / (count(*) - 1) FROM top20) > 0 AS survives_best)
SELECT *, CAST(min_trades AS INT) + CAST(positive_mean AS INT) + CAST(ci_above_zero AS INT) + CAST(multi_era_positive AS INT)
  + CAST(beats_short_all AS INT) + CAST(beats_dependency AS INT) + CAST(survives_100bps AS INT) + CAST(survives_best AS INT) AS n_pass,
  CASE WHEN CAST(min_trades AS INT) + CAST(positive_mean AS INT) + CAST(ci_above_zero AS INT) + CAST(multi_era_positive AS INT)
  + CAST(beats_short_all AS INT) + CAST(beats_dependency AS INT) + CAST(survives_100bps AS INT) + CAST(survives_best AS INT) >= 7
    AND min_trades AND positive_mean AND beats_dependency THEN 'ROBUST OOS EDGE'
  WHEN CAST(min_trades AS INT) + CAST(positive_mean AS INT) + CAST(ci_above_zero AS INT) + CAST(multi_era_positive AS INT)
  + CAST(beats_short_all AS INT) + CAST(beats_dependency AS INT) + CAST(survives_100bps AS INT) + CAST(survives_best AS INT) >= 5
    AND positive_mean AND beats_short_all AND beats_dependency THEN 'PROMISING BUT UNVALIDATED EDGE'
  WHEN positive_mean THEN 'WEAK / INCONCLUSIVE EDGE' ELSE 'NO EVIDENCE OF SHORT EDGE' END AS verdict FROM k""")
def verdict(spark, sf):
    preds = short_preds(spark, sf)
    t = stable(primary_trades(spark, sf))
    rsr = F.col("realized_short_return")
    one = t.agg(F.count(rsr).alias("n"), F.avg(rsr).alias("mean"), F.sum(rsr).alias("total"), F.max(rsr).alias("best"),
                F.avg(sc.short_return(F.col("realized_car"), 100.0)).alias("at100"))
    dep = F.coalesce("company_dependency", F.lit(0.9))
    base = preds.agg(F.avg(rsr).alias("all"), F.avg(F.when(dep >= 0.80, rsr)).alias("dep"))
    lo = resample.interval(resample.block_bootstrap(t, "realized_short_return", "test_year")).select("ci_lo")
    eras = t.groupBy(_era3(F.col("test_year")).alias("era")).agg(F.avg(rsr).alias("m"))
    n_pos = eras.agg(F.count(F.when(F.col("m") > 0, 1)))
    s = one.withColumns({"all": base.select("all").scalar(), "dep": base.select("dep").scalar(), "lo": lo.scalar(),
                         "eras": n_pos.scalar()})
    checks = {
        "min_trades": F.col("n") >= 50,
        "positive_mean": F.col("mean") > 0,
        "ci_above_zero": F.col("lo") > 0,
        "multi_era_positive": F.col("eras") >= 2,
        "beats_short_all": F.col("mean") > F.col("all"),
        "beats_dependency": F.col("mean") > F.col("dep"),
        "survives_100bps": F.col("at100") > 0,
        "survives_best": (F.col("total") - F.col("best")) / (F.col("n") - 1) > 0,
    }
    named = s.select(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    cols = {k: F.col(k) for k in checks}
    n_pass = sum((c.cast("int") for c in cols.values()), F.lit(0))
    return named.select(*checks, n_pass.alias("n_pass"), trades.verdict(cols).alias("verdict"))
