"""Queries: resampling, intervals, tests, model metrics, coverage and volume audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.functions.rounding import rnd
from eventide.operators import audits, metrics, models, resample, robustness, trades
from eventide.plans import inputs
from eventide.plans.oracle_base import EVTS, LEDGER, SHORT, SIGNALS, STUDIES, boot, draw, fixed, r, student_p
from eventide.plans.q_features import _RISK, risk_frame
from eventide.plans.q_trades import _STRATA, _COST, primary_trades, short_preds, signal_ledger, traded_ledger
from eventide.session import stable

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def _rounded(frame, **places):
    return frame.withColumns({c: rnd(c, places.get(c, 6)) for c, t in frame.dtypes if t == "double"})


def _ci(mean="mean", src="boot"):
    return (f"{r(f'quantile_cont({mean}, 0.025)')} AS ci_lo, {r(f'quantile_cont({mean}, 0.975)')} AS ci_hi, "
            f"{r(f'avg(CASE WHEN {mean} > 0 THEN 1e0 ELSE 0e0 END)')} AS p_positive, "
            f"{r(f'avg(CASE WHEN {mean} <= 0 THEN 1e0 ELSE 0e0 END)')} AS p_value")


@register("bootstrap_ci", f"WITH {LEDGER}, {boot('ledger', 'realized_car', 'catalyst_id')} SELECT {_ci()} FROM boot")
def bootstrap_ci(spark, sf):
    return _rounded(resample.interval(resample.bootstrap_means(inputs.ledger(spark, sf), "realized_car", "catalyst_id")))


@register("bootstrap_poisson", f"""WITH {boot('lineitem', 'l_extendedprice', 'l_orderkey', group='l_returnflag')}
SELECT g AS l_returnflag, b, {r('mean', 4)} AS mean FROM boot""")
def bootstrap_poisson(spark, sf):
    """Bootstrap means of every line item's price by return flag; the lines of an order are drawn together."""
    li = inputs.table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    m = resample.bootstrap_means(li, "l_extendedprice", "l_orderkey", ["l_returnflag"])
    return m.select("l_returnflag", F.col("b").cast("long").alias("b"), rnd("mean", 4).alias("mean"))


@register("bootstrap_significance", f"""WITH {SIGNALS}, {boot('traded', 'net_return', 'catalyst_id', 1000)}
SELECT {_ci()}, {r('(SELECT avg(net_return) FROM traded)')} AS observed_mean,
  avg(CASE WHEN mean <= 0 THEN 1e0 ELSE 0e0 END) < 0.05 AS significant_05 FROM boot""")
def bootstrap_significance(spark, sf):
    t = traded_ledger(spark, sf)
    ci = resample.interval(resample.bootstrap_means(t, "net_return", "catalyst_id", n_boot=1000))
    out = ci.withColumn("observed_mean", t.agg(F.avg("net_return")).scalar())
    return _rounded(out.withColumn("significant_05", F.col("p_value") < 0.05))


@register("strategy_bootstrap", f"""WITH {SHORT}, {boot('top20', 'rsr', 'catalyst_id', 5000)} SELECT {_ci()},
  {r('(SELECT avg(rsr) FROM top20)')} AS observed_mean,
  {r('(SELECT avg(rsr) / (stddev_samp(rsr) / sqrt(count(*))) FROM top20)')} AS t_stat FROM boot""")
def strategy_bootstrap(spark, sf):
    t = primary_trades(spark, sf)
    ci = resample.interval(resample.bootstrap_means(t, "realized_short_return", "catalyst_id", n_boot=5000))
    one = stable(metrics.one_sample_t(t, "realized_short_return"))
    return _rounded(ci.withColumns({"observed_mean": one.select("mean").scalar(), "t_stat": one.select("t_stat").scalar()}))


@register("sign_permutation", f"""WITH {SHORT}, v AS (SELECT {fixed('rsr')} AS v, catalyst_id AS i FROM top20),
m AS (SELECT b, sum(CASE WHEN {draw(42, 'b', 'i')} % 2 = 0 THEN v ELSE -v END) AS m FROM v,
  (SELECT unnest(range(2000)) AS b) GROUP BY 1)
SELECT {r('avg(CASE WHEN m >= (SELECT sum(v) FROM v) THEN 1e0 ELSE 0e0 END)')} AS permutation_p FROM m""")
def sign_permutation(spark, sf):
    return _rounded(resample.sign_permutation(primary_trades(spark, sf), "realized_short_return", "catalyst_id"))


@register("block_bootstrap", f"""WITH {SHORT}, y AS (SELECT row_number() OVER (ORDER BY test_year) - 1 AS pos, count(*) OVER () AS n,
    sum(rsr) AS s, count(*) AS c FROM top20 GROUP BY test_year),
d AS (SELECT b, n, pos AS i FROM y, (SELECT unnest(range(2000)) AS b)),
u AS (SELECT b, {draw(42, 'b', 'i')} % n AS pos FROM d),
boot AS (SELECT b, sum(s) / sum(c) AS mean FROM u JOIN y USING (pos) GROUP BY 1) SELECT {_ci()} FROM boot""")
def block_bootstrap(spark, sf):
    return _rounded(resample.interval(resample.block_bootstrap(
        primary_trades(spark, sf), "realized_short_return", "test_year")))


@register("stratification_ci", f"""WITH {_STRATA}, s2 AS (SELECT catalyst_id, stratification || '/' || bucket AS sb,
    -realized_car - {_COST} AS ret FROM st), {boot('s2', 'ret', 'catalyst_id', group='sb')}
SELECT g AS stratum, {_ci()} FROM boot GROUP BY 1""")
def stratification_ci(spark, sf):
    """Interval of the mean short return per stratum."""
    st = trades.strata(risk_frame(spark, sf)).select(
        "catalyst_id", F.concat_ws("/", "stratification", "bucket").alias("stratum"),
        sc.short_return(F.col("realized_car")).alias("ret"))
    m = resample.bootstrap_means(stable(st), "ret", "catalyst_id", ["stratum"])
    return _rounded(resample.interval(m, ["stratum"]))


_CONF = LEDGER + """,
res AS (SELECT catalyst_id, realized_car - expected_car AS residual, row_number() OVER (ORDER BY abs(realized_car - expected_car)) - 1
    AS i, count(*) OVER () AS n FROM ledger),
q AS (SELECT abs(residual) AS q FROM res WHERE i = CAST(ceil(least(1e0, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1)) AS BIGINT))"""


def _residuals(spark, sf):
    return inputs.ledger(spark, sf).select(
        F.col("catalyst_id").alias("id"), (F.col("realized_car") - F.col("expected_car")).alias("residual"))


@register("conformal", f"""WITH {_CONF} SELECT catalyst_id, {r('expected_car - q', 8)} AS lo, {r('expected_car + q', 8)} AS hi,
  CASE WHEN (expected_car - q) * coalesce(company_dependency, 0.9::DOUBLE) > 0 THEN 'CONFIDENT LONG'
    WHEN (expected_car + q) * coalesce(company_dependency, 0.9::DOUBLE) < 0 THEN 'CONFIDENT SHORT' ELSE 'UNCERTAIN' END
    AS confidence_signal FROM ledger, q""")
def conformal(spark, sf):
    q = metrics.conformal_quantile(_residuals(spark, sf), "residual").select("q").scalar()
    dep = F.coalesce("company_dependency", F.lit(0.9))
    lo, hi = F.col("expected_car") - F.col("q"), F.col("expected_car") + F.col("q")
    return inputs.ledger(spark, sf).withColumn("q", q).select(
        "catalyst_id", rnd(lo, 8).alias("lo"), rnd(hi, 8).alias("hi"),
        sc.confidence_signal(lo * dep, hi * dep).alias("confidence_signal"))


@register("residual_bootstrap", f"""WITH {LEDGER}, q AS (SELECT quantile_cont(realized_car - expected_car, 0.025) AS lo,
    quantile_cont(realized_car - expected_car, 0.975) AS hi FROM ledger)
SELECT catalyst_id, {r('expected_car + lo')} AS lo, {r('expected_car + hi')} AS hi FROM ledger, q""")
def residual_bootstrap(spark, sf):
    return _rounded(resample.residual_intervals(
        inputs.ledger(spark, sf), _residuals(spark, sf), "catalyst_id", "expected_car", "residual"))


@register("residual_source", f"""WITH {LEDGER} SELECT 'ledger' AS source, count(*) AS n,
  {r('avg(realized_car - expected_car)')} AS mean_residual FROM ledger""")
def residual_source(spark, sf):
    """The exported source holds fewer than ten rows here, so the ledger is used."""
    res = _residuals(spark, sf)
    nations = inputs.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(0.1).alias("residual"))
    picked = metrics.pick_residuals([("export", nations), ("ledger", res), ("in_sample", res)])
    return picked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("residual")).alias("mean_residual"))


_WELCH = f"""{SHORT}, s AS (SELECT count(*) FILTER (WHERE clinical_failure = 1) AS n1,
    count(*) FILTER (WHERE clinical_failure = 0) AS n0, avg(realized_car) FILTER (WHERE clinical_failure = 1) AS m1,
    avg(realized_car) FILTER (WHERE clinical_failure = 0) AS m0, var_samp(realized_car) FILTER (WHERE clinical_failure = 1) AS v1,
    var_samp(realized_car) FILTER (WHERE clinical_failure = 0) AS v0 FROM short),
w AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
    pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM s),
p AS (SELECT {student_p('(SELECT t FROM w)', '(SELECT df FROM w)')} AS p_value)"""


@register("welch_t", f"""WITH {_WELCH}
SELECT n1 AS n_failure, n0 AS n_success, {r('m1')} AS failure_mean, {r('m0')} AS success_mean, {r('t')} AS t_stat, {r('df', 3)} AS df,
  {r('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))')} AS cohens_d, {r('p_value', 5)} AS p_value FROM w, p""")
def welch_t(spark, sf):
    return _rounded(metrics.welch(short_preds(spark, sf), "clinical_failure", "realized_car"), df=3, p_value=5)


@register("welch_p_value", f"""WITH {_WELCH} SELECT {r('t')} AS t_stat, {r('df', 3)} AS df, {r('p_value', 5)} AS p_value FROM w, p""")
def welch_p_value(spark, sf):
    w = metrics.welch(short_preds(spark, sf), "clinical_failure", "realized_car")
    return _rounded(w.select("t_stat", "df", "p_value"), df=3, p_value=5)


@register("failure_car_vs_dependency", f"""WITH {SHORT}, s AS (SELECT count(*) AS n, corr(company_dependency, realized_car) AS r FROM short
    WHERE clinical_failure = 1 AND company_dependency IS NOT NULL),
w AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM s),
p AS (SELECT {student_p('(SELECT t FROM w)', '(SELECT df FROM w)')} AS p_value)
SELECT n, {r('r')} AS correlation, {r('t')} AS t_stat, df, {r('p_value', 5)} AS p_value FROM w, p""")
def failure_car_vs_dependency(spark, sf):
    f = short_preds(spark, sf).filter("clinical_failure = 1")
    return _rounded(metrics.pearson_test(f, "company_dependency", "realized_car"), p_value=5)


@register("winsor_trim", f"""WITH {SHORT}, k AS (SELECT rsr, row_number() OVER (ORDER BY rsr, catalyst_id) AS rn, count(*) OVER () AS n FROM top20)
SELECT {r('avg(greatest(least(rsr, 0.50::DOUBLE), (-0.50)::DOUBLE))')} AS cap_50pct,
  {r('avg(greatest(least(rsr, 0.30::DOUBLE), (-0.30)::DOUBLE))')} AS cap_30pct,
  {r('avg(greatest(least(rsr, 0.20::DOUBLE), (-0.20)::DOUBLE))')} AS cap_20pct,
  {r('avg(rsr) FILTER (WHERE rn > floor(n * 0.1::DOUBLE) AND rn <= n - floor(n * 0.1::DOUBLE))')} AS trimmed_mean_10pct FROM k""")
def winsor_trim(spark, sf):
    t = primary_trades(spark, sf)
    w = metrics.winsorized_means(t, "realized_short_return", {"cap_50pct": 0.5, "cap_30pct": 0.3, "cap_20pct": 0.2})
    tm = metrics.trimmed_mean(t, "realized_short_return", "catalyst_id").select("trimmed_mean").scalar()
    return _rounded(w.withColumn("trimmed_mean_10pct", tm))


@register("shrinkage", f"""WITH {SHORT}, a AS (SELECT ticker, count(realized_car) AS n, avg(realized_car) AS m FROM short
    WHERE clinical_failure = 1 GROUP BY 1), g AS (SELECT avg(realized_car) AS g FROM short WHERE clinical_failure = 1)
SELECT ticker, n, {r('n / (n + 8e0) * m + (1 - n / (n + 8e0)) * g')} AS shrunk_mean FROM a, g""")
def shrinkage(spark, sf):
    f = short_preds(spark, sf).filter("clinical_failure = 1")
    overall = f.agg(F.avg("realized_car")).scalar()
    a = f.groupBy("ticker").agg(F.count("realized_car").alias("n"), F.avg("realized_car").alias("m"))
    a = a.withColumn("g", overall)
    return a.select("ticker", "n", rnd(models.shrink(F.col("m"), F.col("n"), F.col("g"))).alias("shrunk_mean"))


@register("conditional_means", f"""WITH {SHORT} SELECT test_year,
  {r('coalesce(avg(realized_car) FILTER (WHERE clinical_success = 1), 0)')} AS success_mean,
  {r('coalesce(avg(realized_car) FILTER (WHERE clinical_success = 0), -0.10)')} AS failure_mean FROM short GROUP BY 1""")
def conditional_means(spark, sf):
    y, car = F.col("clinical_success"), F.col("realized_car")
    return short_preds(spark, sf).groupBy("test_year").agg(
        rnd(F.coalesce(F.avg(F.when(y == 1, car)), F.lit(0.0))).alias("success_mean"),
        rnd(F.coalesce(F.avg(F.when(y == 0, car)), F.lit(-0.10))).alias("failure_mean"))


@register("exploratory_metrics", f"""WITH {LEDGER}, x AS (SELECT clinical_success AS y, 1 - p_failure AS p FROM ledger
    WHERE clinical_success IS NOT NULL), m AS (SELECT avg(y) AS m FROM x)
SELECT {r('any_value(m)')} AS marginal_rate, {r('avg(pow(y - m, 2))')} AS brier_marginal, {r('avg(pow(y - p, 2))')} AS brier_base_rate
FROM x, m""")
def exploratory_metrics(spark, sf):
    x = inputs.ledger(spark, sf).filter("clinical_success is not null").select(
        F.col("clinical_success").alias("y"), (1 - F.col("p_failure")).alias("p"))
    m = x.agg(F.avg("y")).scalar()
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return x.withColumn("m", m).agg(rnd(F.max("m")).alias("marginal_rate"), rnd(F.avg(sq("y", "m"))).alias("brier_marginal"),
                                    rnd(F.avg(sq("y", "p"))).alias("brier_base_rate"))


@register("brier_logloss", f"""WITH {SHORT}, x AS (SELECT test_year, clinical_failure AS y, p_failure AS p,
    least(greatest(p_failure, 1e-6), 1 - 1e-6) AS q FROM short)
SELECT test_year, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_events, {r('avg(pow(p - y, 2))')} AS brier,
  {r('avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END)')} AS log_loss FROM x GROUP BY 1""")
def brier_logloss(spark, sf):
    return _rounded(metrics.probability_scores(short_preds(spark, sf), "clinical_failure", "p_failure", ["test_year"]))


@register("roc_auc", f"""WITH {SHORT}, k AS (SELECT test_year, clinical_failure AS y, rank() OVER (PARTITION BY test_year ORDER BY p_failure)
    + (count(*) OVER (PARTITION BY test_year, p_failure) - 1) / 2e0 AS rk FROM short)
SELECT test_year, {r('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)))')} AS roc_auc
FROM k GROUP BY 1""")
def roc_auc(spark, sf):
    return _rounded(metrics.roc_auc(short_preds(spark, sf), "clinical_failure", "p_failure", ["test_year"]))


@register("average_precision", f"""WITH {SHORT}, d AS (SELECT p_failure AS p, CAST(sum(clinical_failure) AS BIGINT) AS pos, count(*) AS n FROM short GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM d)
SELECT {r('sum(pos * tp / k) / sum(pos)')} AS average_precision FROM c""")
def average_precision(spark, sf):
    return _rounded(metrics.average_precision(short_preds(spark, sf), "clinical_failure", "p_failure"))


@register("calibration_line", f"""WITH {SHORT}, x AS (SELECT clinical_failure AS y, ln(least(greatest(p_failure, 1e-6), 1 - 1e-6)
    / least(greatest(1 - p_failure, 1e-6), 1 - 1e-6)) AS x FROM short)
SELECT {r('regr_slope(y, x)')} AS calibration_slope, {r('regr_intercept(y, x)')} AS calibration_intercept FROM x""")
def calibration_line(spark, sf):
    return _rounded(metrics.calibration_line(short_preds(spark, sf), "clinical_failure", "p_failure"))


@register("reliability_bins", f"""WITH {SHORT}, e AS (SELECT quantile_cont(p_failure, 0.2) AS a, quantile_cont(p_failure, 0.4) AS b,
    quantile_cont(p_failure, 0.6) AS c, quantile_cont(p_failure, 0.8) AS d FROM short),
x AS (SELECT clinical_failure AS y, p_failure AS p, CAST(p_failure > a AS INT) + CAST(p_failure > b AS INT)
    + CAST(p_failure > c AS INT) + CAST(p_failure > d AS INT) AS bin FROM short, e)
SELECT bin, {r('avg(p)')} AS predicted_mean, {r('avg(y)')} AS observed_rate, count(*) AS n FROM x GROUP BY 1""")
def reliability_bins(spark, sf):
    return _rounded(metrics.reliability_bins(short_preds(spark, sf), "clinical_failure", "p_failure"))


@register("precision_at_k", f"""WITH {SHORT}, t AS (SELECT * FROM short ORDER BY p_failure DESC, catalyst_id LIMIT 10)
SELECT count(*) AS k, {r('avg(major_negative_event)')} AS precision FROM t""")
def precision_at_k(spark, sf):
    return _rounded(metrics.precision_at_k(short_preds(spark, sf), "major_negative_event", "p_failure", "catalyst_id", 10))


@register("impute_scale", """WITH x AS (SELECT doc_id, n_chars AS a, CASE WHEN doc_id % 4 <> 0 THEN length(lang) * doc_id END AS b,
    NULL::DOUBLE AS c FROM documents),
m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM x),
f AS (SELECT doc_id, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM x, m)
SELECT doc_id, """ + r("(a - avg(a) OVER ()) / stddev_pop(a) OVER ()") + " AS a, "
          + r("(b - avg(b) OVER ()) / stddev_pop(b) OVER ()") + " AS b, 0e0 AS c FROM f")
def impute_scale(spark, sf):
    key = F.col("doc_id")
    x = inputs.table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("a"),
        F.when(key % 4 != 0, F.length("lang") * key).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    s = models.fit_scaler(x, ["a", "b", "c"])
    return _rounded(x.select("doc_id", *[e.alias(c) for c, e in s.columns().items()]))


@register("ridge", f"""WITH {SHORT}, x AS (SELECT catalyst_id, p_failure AS x, realized_car AS y FROM short),
z AS (SELECT catalyst_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z, y - avg(y) OVER () AS yc, avg(y) OVER () AS m FROM x),
w AS (SELECT sum(z * yc) / (sum(z * z) + 5e0) AS w FROM z)
SELECT catalyst_id, {r('m + w * z', 7)} AS predicted FROM z, w""")
def ridge(spark, sf):
    df = stable(short_preds(spark, sf).select("catalyst_id", "p_failure", "realized_car"))
    m = models.fit_ridge(df, ["p_failure"], "realized_car", models.SHORT_ALPHA)
    return df.select("catalyst_id", rnd(m.linear(), 7).alias("predicted"))


@register("coverage_counts", f"""WITH {LEDGER} SELECT count(*) AS n_catalysts, count(DISTINCT ticker) AS n_tickers,
  count(clinical_success) AS n_labelled, count(company_dependency) AS n_exposure, count(DISTINCT drug_name) AS n_drugs,
  CAST(max(announcement_date) AS VARCHAR) AS last_event, {r('max(realized_car)')} AS max_car FROM ledger""")
def coverage_counts(spark, sf):
    return inputs.ledger(spark, sf).agg(
        F.count(F.lit(1)).alias("n_catalysts"), F.count_distinct("ticker").alias("n_tickers"),
        F.count("clinical_success").alias("n_labelled"), F.count("company_dependency").alias("n_exposure"),
        F.count_distinct("drug_name").alias("n_drugs"), F.max("announcement_date").cast("string").alias("last_event"),
        rnd(F.max("realized_car")).alias("max_car"))


@register("volume_audit", f"""WITH {SIGNALS}, c AS (SELECT count(*) AS n, count(clinical_success) AS es, count(company_dependency) AS mf,
    count(*) FILTER (WHERE side <> 0) AS tr FROM sided)
SELECT 'catalysts' AS "check", CASE WHEN n >= 100 THEN 'pass' ELSE 'fail' END AS status, n AS value FROM c
UNION ALL SELECT 'event_study', CASE WHEN es >= 0.6 * n THEN 'pass' WHEN es >= 0.5 * n THEN 'partial' ELSE 'fail' END, es FROM c
UNION ALL SELECT 'price_coverage', CASE WHEN es >= 0.95 * n THEN 'pass' WHEN es >= 0.75 * n THEN 'partial' ELSE 'fail' END, es FROM c
UNION ALL SELECT 'market_features', CASE WHEN mf >= es THEN 'pass' ELSE 'partial' END, mf FROM c
UNION ALL SELECT 'oos_ledger', CASE WHEN n >= 20 THEN 'pass' WHEN n > 0 THEN 'partial' ELSE 'fail' END, n FROM c
UNION ALL SELECT 'oos_trades', CASE WHEN tr >= 20 THEN 'pass' WHEN tr >= 5 THEN 'partial' ELSE 'fail' END, tr FROM c""")
def volume_audit(spark, sf):
    led = signal_ledger(spark, sf)
    return audits.volume_audit(led.agg(
        F.count(F.lit(1)).alias("n_catalysts"), F.count("clinical_success").alias("n_event_study"),
        F.count("company_dependency").alias("n_market_features"), F.count("expected_car").alias("n_ledger"),
        F.count(F.when(sc.side_of(F.col("trade_signal")) != 0, 1)).alias("n_trades")))


_ERA3 = "CASE WHEN test_year <= 1996 THEN 'early' WHEN test_year <= 1998 THEN 'middle' ELSE 'late' END"


def _suite_sql() -> str:
    def ci(prefix, src):
        return [(f"{prefix}ci_lo", f"quantile_cont(mean, 0.025)", src), (f"{prefix}ci_hi", "quantile_cont(mean, 0.975)", src),
                (f"{prefix}p_positive", "avg(CASE WHEN mean > 0 THEN 1e0 ELSE 0e0 END)", src)]

    winsor = [(f"winsorized_{c}pct", f"avg(greatest(least(rsr, 0.{c}::DOUBLE), (-0.{c})::DOUBLE))", "k") for c in (50, 30, 20)]
    rows = [
        ("n_trades", "count(*)", "k"), ("n_years", "count(DISTINCT test_year)", "k"), ("observed_mean", "avg(rsr)", "k"), ("t_stat", "any_value(t)", "tt"),
        *ci("bootstrap_", "boot"), ("permutation_p", "avg(CASE WHEN m >= (SELECT sum(v) FROM v) THEN 1e0 ELSE 0e0 END)", "perm"), *ci("block_", "blocks"),
        ("loo_worst_mean", "(sum(rsr) - max(rsr)) / (count(*) - 1)", "k"), ("loo_best_mean", "(sum(rsr) - min(rsr)) / (count(*) - 1)", "k"), *winsor,
        ("trimmed_mean_10pct", "avg(rsr) FILTER (WHERE tr > floor(tn * 0.1::DOUBLE) AND tr <= tn - floor(tn * 0.1::DOUBLE))", "k"),
    ]
    plain = "\nUNION ALL ".join(f"SELECT '{name}' AS metric, {r(expr)} AS value FROM {src}" for name, expr, src in rows)
    eras = "\nUNION ALL ".join(f"SELECT 'era_' || era || '_{name}', {r(expr)} FROM k GROUP BY era" for name, expr in (
        ("n", "count(*)"), ("mean", "avg(rsr)"), ("win_rate", "avg(CASE WHEN rsr > 0 THEN 1e0 ELSE 0e0 END)")))
    bounds = "\nUNION ALL ".join(f"SELECT 'era_' || g || '_{name}', {r(f'quantile_cont(mean, {q})')} FROM eb GROUP BY g" for name, q in (("ci_lo", 0.025), ("ci_hi", 0.975)))
    return f"""WITH {SHORT}, k AS (SELECT *, row_number() OVER (ORDER BY rsr, catalyst_id) AS tr, count(*) OVER () AS tn, {_ERA3} AS era FROM top20),
tt AS (SELECT avg(rsr) / (stddev_samp(rsr) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM k),
{boot('k', 'rsr', 'catalyst_id', 5000)}, {boot('k', 'rsr', 'catalyst_id', 500, name='eb', group='era')},
v AS (SELECT {fixed('rsr')} AS v, catalyst_id AS i FROM k),
perm AS (SELECT b, sum(CASE WHEN {draw(42, 'b', 'i')} % 2 = 0 THEN v ELSE -v END) AS m FROM v, (SELECT unnest(range(2000)) AS b) GROUP BY 1),
y AS (SELECT row_number() OVER (ORDER BY test_year) - 1 AS pos, count(*) OVER () AS n, sum(rsr) AS s, count(*) AS c FROM k GROUP BY test_year),
slots AS (SELECT b, n, pos AS i FROM y, (SELECT unnest(range(2000)) AS b)), drawn AS (SELECT b, {draw(42, 'b', 'i')} % n AS pos FROM slots),
blocks AS (SELECT b, sum(s) / sum(c) AS mean FROM drawn JOIN y USING (pos) GROUP BY 1)
{plain}
UNION ALL {eras}
UNION ALL {bounds}
UNION ALL SELECT 'ttest_p_value', {r(student_p('(SELECT t FROM tt)', '(SELECT df FROM tt)'), 4)}"""


@register("robustness_suite", _suite_sql())
def robustness_suite(spark, sf):
    """Every member of the suite over the primary short strategy."""
    era = F.when(F.col("test_year") <= 1996, "early").when(F.col("test_year") <= 1998, "middle").otherwise("late")
    out = robustness.suite(primary_trades(spark, sf), "realized_short_return", "catalyst_id", "test_year", era)
    places = F.when(F.col("metric") == "ttest_p_value", rnd("value", 4)).otherwise(rnd("value"))
    return out.select("metric", places.alias("value"))
