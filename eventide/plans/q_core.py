"""Queries: event study, series and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions.rounding import rnd
from eventide.operators import asof, eventstudy, series
from eventide.operators.ordered import quantiles
from eventide.plans import inputs
from eventide.session import stable
from eventide.plans.oracle_base import ALIGNED, BARS, BENCH, CUTS, EVTS, FACTS, RETURNS, r

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def _aligned(spark, sf, key="p_brand"):
    bars = inputs.bars(spark, sf, key)
    bench = series.benchmark_returns(inputs.benchmarks(spark, sf, key))
    return bars, series.align(series.simple_returns(bars), bench)


@register("returns", f"""WITH {RETURNS} SELECT ticker, CAST(date AS VARCHAR) AS date, {r('ret', 8)} AS ret FROM rets""")
def returns(spark, sf):
    rets = series.simple_returns(inputs.bars(spark, sf))
    return rets.select("ticker", F.col("date").cast("string"), rnd("ret", 8).alias("ret"))


@register("benchmark_returns", f"""WITH {BENCH} SELECT CAST(date AS VARCHAR) AS date, {r('spy', 8)} AS spy,
  {r('xbi', 8)} AS xbi FROM spy FULL JOIN xbi USING (date)""")
def benchmark_returns(spark, sf):
    wide = series.benchmark_returns(inputs.benchmarks(spark, sf))
    return wide.select(F.col("date").cast("string"), rnd("spy", 8).alias("spy"), rnd("xbi", 8).alias("xbi"))


@register("aligned_returns", f"""WITH {ALIGNED} SELECT ticker, CAST(date AS VARCHAR) AS date, idx,
  {r('ret', 8)} AS ret, {r('spy', 8)} AS spy, {r('xbi', 8)} AS xbi FROM aligned""")
def aligned_returns(spark, sf):
    from pyspark.sql import Window

    _, al = _aligned(spark, sf)
    idx = (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).cast("long")
    return al.select(
        "ticker", F.col("date").cast("string"), idx.alias("idx"),
        *[rnd(c, 8).alias(c) for c in ("ret", "spy", "xbi")],
    )


MATCHED_ONLY = """matched AS (SELECT e.*, (SELECT min(a.date) FROM aligned a WHERE a.ticker = e.ticker
    AND a.date >= e.announcement_date) AS session_date FROM
    (SELECT DISTINCT ticker, announcement_date FROM evts) e),
guarded AS (SELECT m.ticker, m.announcement_date, m.session_date, a.idx, a.len,
    CASE WHEN b.ticker IS NULL THEN 'no_price_data'
      WHEN coalesce(t.len, 0) < 80 THEN 'insufficient_history'
      WHEN m.session_date IS NULL THEN 'no_event_date_match'
      WHEN a.idx < 250 THEN 'insufficient_pre_event_history'
      WHEN m.session_date - m.announcement_date > 7 THEN 'event_date_outside_price_range'
      ELSE 'ok' END AS price_status
  FROM matched m LEFT JOIN aligned a ON a.ticker = m.ticker AND a.date = m.session_date
  LEFT JOIN (SELECT DISTINCT ticker FROM bars) b ON b.ticker = m.ticker
  LEFT JOIN (SELECT ticker, count(*) AS len FROM aligned GROUP BY 1) t ON t.ticker = m.ticker),
est AS (SELECT g.ticker, g.announcement_date, any_value(g.idx) AS idx, any_value(g.len) AS len,
    regr_slope(a.ret, a.spy) AS b_s, regr_intercept(a.ret, a.spy) AS a_s,
    regr_slope(a.ret, a.xbi) AS b_x, regr_intercept(a.ret, a.xbi) AS a_x, count(*) AS n_est
  FROM guarded g JOIN aligned a ON a.ticker = g.ticker AND a.idx BETWEEN g.idx - 250 AND g.idx - 30
  WHERE g.price_status = 'ok' GROUP BY 1, 2),
wins(window_label, w0, w1) AS (VALUES ('[-5,+5]', -5, 5), ('[-1,+1]', -1, 1), ('[0,+1]', 0, 1),
  ('[0,+5]', 0, 5), ('[0,+20]', 0, 20)),
meas AS (SELECT e.ticker, e.announcement_date, w.window_label, sum(a.ret) AS raw,
    sum(a.ret - a.spy) AS adj_s, sum(a.ret - a.xbi) AS adj_x,
    sum(a.ret - (e.a_s + e.b_s * a.spy)) AS car_s, sum(a.ret - (e.a_x + e.b_x * a.xbi)) AS car_x,
    any_value(e.a_s) AS a_s, any_value(e.b_s) AS b_s, any_value(e.a_x) AS a_x, any_value(e.b_x) AS b_x
  FROM est e CROSS JOIN wins w JOIN aligned a ON a.ticker = e.ticker
    AND a.idx BETWEEN e.idx + w.w0 AND e.idx + w.w1 GROUP BY 1, 2, 3),
long AS (
  SELECT ticker, announcement_date, window_label, 'RAW' AS benchmark, raw AS raw_return, raw AS car,
    NULL::DOUBLE AS alpha, NULL::DOUBLE AS beta FROM meas
  UNION ALL SELECT ticker, announcement_date, window_label, 'SPY', NULL, adj_s, NULL, NULL FROM meas
  UNION ALL SELECT ticker, announcement_date, window_label, 'XBI', NULL, adj_x, NULL, NULL FROM meas
  UNION ALL SELECT ticker, announcement_date, window_label, 'MARKET_MODEL', NULL, car_s, a_s, b_s FROM meas
  UNION ALL SELECT ticker, announcement_date, window_label, 'XBI_MODEL', NULL, car_x, a_x, b_x FROM meas)"""


_MATCHED = ",\n".join((ALIGNED, EVTS, MATCHED_ONLY))


def _study_events(spark, sf):
    return inputs.catalysts(spark, sf).select(
        "catalyst_id", "ticker", "announcement_date", "clinical_success", "drug_name"
    )


@register("event_study_car", f"""WITH {_MATCHED}
SELECT e.catalyst_id, e.ticker, g.price_status, l.window_label, l.benchmark, {r('l.raw_return')} AS raw_return,
  {r('l.car')} AS car, {r('l.alpha')} AS alpha, {r('l.beta')} AS beta
FROM evts e JOIN guarded g USING (ticker, announcement_date) LEFT JOIN long l USING (ticker, announcement_date)""")
def event_study_car(spark, sf):
    bars, al = _aligned(spark, sf)
    es = eventstudy.event_study(_study_events(spark, sf), al, bars)
    return es.select(
        "catalyst_id", "ticker", "price_status", "window_label", "benchmark",
        *[rnd(c).alias(c) for c in ("raw_return", "car", "alpha", "beta")],
    )


@register("event_study_by_outcome", f"""WITH {_MATCHED}
SELECT CAST(clinical_success AS DOUBLE) AS clinical_success, count(*) AS n, {r('avg(car)')} AS mean_car,
  {r('quantile_cont(car, 0.5)')} AS median_car, {r('stddev_samp(car)')} AS std_car
FROM evts JOIN long USING (ticker, announcement_date)
WHERE window_label = '[-1,+1]' AND benchmark = 'MARKET_MODEL' AND clinical_success IS NOT NULL GROUP BY 1""")
def event_study_by_outcome(spark, sf, key="p_brand"):
    bars, al = _aligned(spark, sf, key)
    events = _study_events(spark, sf)
    if key == "p_type":  # the six part types stand in for tickers on the smallest scale
        kinds = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
        names = F.array(*[F.lit(k) for k in kinds])
        pos = F.substring_index("ticker", "#", -1).cast("int") % len(kinds) + 1
        events = events.withColumn("ticker", F.element_at(names, pos))
    return outcome_summary(eventstudy.primary_car(events, al, bars))


def outcome_summary(cars):
    """Count, mean, exact median and sample deviation of CAR per outcome."""
    labelled = stable(cars.filter(F.col("clinical_success").isNotNull()).select("clinical_success", "car"))
    stats = labelled.groupBy("clinical_success").agg(
        F.count("car").alias("n"), F.avg("car").alias("m"), F.stddev_samp("car").alias("s")
    )
    med = quantiles(labelled, ["clinical_success"], "car", {"med": 0.5})
    return stats.join(med, "clinical_success").select(
        F.col("clinical_success").cast("double"),
        "n", rnd("m").alias("mean_car"), rnd("med").alias("median_car"), rnd("s").alias("std_car"),
    )


@register("guard_status_counts", f"""WITH {_MATCHED} SELECT price_status, count(*) AS n FROM evts
  JOIN guarded USING (ticker, announcement_date) GROUP BY 1""")
def guard_status_counts(spark, sf):
    bars, al = _aligned(spark, sf)
    m = eventstudy.match_events(_study_events(spark, sf), eventstudy.session_measures(al), bars)
    return m.groupBy("price_status").agg(F.count(F.lit(1)).alias("n"))
