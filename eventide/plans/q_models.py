"""Queries: fitted models, walk-forward ledgers, ablations, holdout, classifier and ranking.

Fits are iterative; their oracles run the same steps in recursive SQL (`oracle_models.py`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.rounding import rnd
from eventide.operators import ablation as ab
from eventide.operators import classifier, features, metrics, models, ranking, trades
from eventide.plans import inputs, oracle_models as om
from eventide.plans.oracle_base import LEDGER, r
from eventide.plans.q_features import FRAME, short_edge_frame
from eventide.session import stable

QUERIES, ORACLE = {}, {}

FIRST_TRAIN_END = 1998
HOLDOUT = (2000, 2001)


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def model_frame(spark, sf):
    """Modelling rows with point-in-time features and risk flags, materialised once for all folds."""
    df = stable(short_edge_frame(spark, sf))
    return stable(features.risk_flags(df))


P_COLS = list(features.resolve_features("everything_no_preclinical"))
CAR_COLS = list(features.MARKET)
SHORT_CAR_COLS = features.resolve_features("market_plus_company")


def _out(df):
    return df.withColumns({c: rnd(c) for c, t in df.dtypes if t == "double"})


def _folds_sql(first: int, minimum: int) -> str:
    """folds (win), train and test rows of an expanding walk-forward."""
    return f"""folds AS (SELECT y - 1 AS win FROM (SELECT DISTINCT catalyst_year AS y FROM frame) WHERE y - 1 >= {first}
    AND (SELECT count(*) FROM frame f WHERE f.catalyst_year <= y - 1) >= {minimum}),
train AS MATERIALIZED (SELECT k.win, f.* FROM frame f JOIN folds k ON f.catalyst_year <= k.win),
test AS MATERIALIZED (SELECT catalyst_year - 1 AS win, * FROM frame WHERE catalyst_year - 1 IN (SELECT win FROM folds))"""


def _one_window_sql(train: str, test: str) -> str:
    return f"""train AS MATERIALIZED (SELECT 0 AS win, * FROM frame WHERE {train}),
test AS MATERIALIZED (SELECT 0 AS win, * FROM frame WHERE {test})"""


_COST = "2e0 * (25e0 / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0)"


@register("walk_forward", f"""WITH RECURSIVE {FRAME}, {_folds_sql(FIRST_TRAIN_END, 10)},
{om.expected_car('m', 'train', 'folds', P_COLS, CAR_COLS, 'test')},
adj AS MATERIALIZED (SELECT *, expected_car * company_dependency AS expected_car_adj, CAST(win + 1 AS INTEGER) AS test_year FROM m),
pct AS (SELECT *, (rank() OVER (PARTITION BY test_year ORDER BY expected_car_adj) + (count(*) OVER (PARTITION BY test_year, expected_car_adj) - 1) / 2e0)
    / count(*) OVER (PARTITION BY test_year) AS q FROM adj)
SELECT catalyst_id, ticker, clinical_success, {r('realized_car')} AS realized_car, {r('company_dependency')} AS company_dependency, {r('p_success')} AS p_success,
  {r('expected_car')} AS expected_car, {r('expected_car_adj')} AS expected_car_adj, CAST(win AS INTEGER) AS train_end_year, test_year,
  'expected_car_wf_' || win AS model_version, {r('q')} AS expected_car_pct, CASE WHEN q >= 0.90::DOUBLE THEN 'STRONG LONG' WHEN q >= 0.75::DOUBLE THEN 'LONG'
    WHEN q <= 0.10::DOUBLE THEN 'STRONG SHORT' WHEN q <= 0.25::DOUBLE THEN 'SHORT' ELSE 'NO TRADE' END AS trade_signal FROM pct""")
def walk_forward(spark, sf):
    wf = models.walk_forward(model_frame(spark, sf), P_COLS, CAR_COLS, FIRST_TRAIN_END)
    return _out(trades.percentile_signals(stable(wf), "expected_car_adj", ["test_year"]))


def _tail_sql(name: str, source: str, cols) -> str:
    """Fits of the drop classifier and of the drop magnitude."""
    rows = f"SELECT win, %s AS y, {', '.join(cols)} FROM {source} WHERE realized_car IS NOT NULL"
    return ",\n".join((
        om.logistic(f"{name}_c", rows % "CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1 ELSE 0 END", cols),
        om.ridge(f"{name}_g", rows % "realized_car" + " AND realized_car <= (-0.20)::DOUBLE", cols, 5.0),
    ))


def _tail_scores_sql(name: str, cols) -> str:
    p = f"coalesce({om.sigmoid(om.line(f'{name}_c', cols, 't'))}, {name}_c_s.y_mean)"
    g = f"CASE WHEN {name}_g_s.n_rows >= 5 THEN {om.line(f'{name}_g', cols, 't')} ELSE coalesce({name}_g_s.y_mean, (-0.20)::DOUBLE) END"
    return f"{p} AS p_major_drop, {g} AS magnitude"


_HOLDOUT_TAIL = f"""{FRAME}, {_one_window_sql(f'catalyst_year < {HOLDOUT[0]}', f'catalyst_year >= {HOLDOUT[0]}')}, {_tail_sql('d', 'train', P_COLS)},
drops AS MATERIALIZED (SELECT t.*, {_tail_scores_sql('d', P_COLS)} FROM test t {om.joined('d_c', 't')} {om.joined('d_g', 't')})"""


@register("tail_risk", f"""WITH RECURSIVE {_HOLDOUT_TAIL} SELECT catalyst_id, {r('p_major_drop')} AS p_major_drop,
  {r('magnitude')} AS expected_drop_magnitude, {r('p_major_drop * -least(magnitude, 0)')} AS tail_risk_score, major_negative_event FROM drops""")
def tail_risk(spark, sf):
    df = model_frame(spark, sf)
    train, test = df.filter(F.col("catalyst_year") < HOLDOUT[0]), df.filter(F.col("catalyst_year") >= HOLDOUT[0])
    out = models.predict_tail_risk(test, models.fit_tail_risk(train, P_COLS))
    return _out(out.select("catalyst_id", "p_major_drop", "expected_drop_magnitude", "tail_risk_score", "major_negative_event"))


@register("tail_risk_metrics", f"""WITH RECURSIVE {_HOLDOUT_TAIL}, k AS (SELECT major_negative_event AS y, {r('p_major_drop')} AS p FROM drops),
ranked AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM k),
d AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM d)
SELECT (SELECT {r('avg(y)')} FROM k) AS base_rate,
  (SELECT {r('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)))')} FROM ranked) AS roc_auc,
  (SELECT {r('sum(pos * tp / seen) / sum(pos)')} FROM c) AS average_precision""")
def tail_risk_metrics(spark, sf):
    t = stable(tail_risk(spark, sf))
    auc = metrics.roc_auc(t, "major_negative_event", "p_major_drop").select("roc_auc").scalar()
    ap = metrics.average_precision(t, "major_negative_event", "p_major_drop").select("average_precision").scalar()
    base = t.agg(F.avg("major_negative_event").alias("base_rate"))
    return _out(base.withColumns({"roc_auc": auc, "average_precision": ap}))


def _short_sql(p_cols, car_cols) -> str:
    """CTE short: the short ledger with its nested thresholds."""
    def rows(y, where, cols):
        return f"SELECT win, {y} AS y, {', '.join(cols)} FROM train WHERE {where}"

    def mean_car(fit, default):
        return f"CASE WHEN {fit}_s.n_rows >= 8 THEN {om.line(fit, car_cols, 't')} ELSE coalesce({fit}_s.y_mean, {default}::DOUBLE) END"

    capped = f"CASE WHEN cf_s.n_rows >= 8 THEN least({om.line('cf', car_cols, 't')}, 0) ELSE coalesce(cf_s.y_mean, (-0.10)::DOUBLE) END"
    best = ", ".join(f"({t}::DOUBLE)" for t in models.THRESHOLDS)
    return f"""years AS (SELECT DISTINCT catalyst_year AS y FROM frame),
inner_years AS MATERIALIZED (SELECT win, y FROM (SELECT k.win, y, row_number() OVER (PARTITION BY k.win ORDER BY y DESC) AS rn, count(*) OVER (PARTITION BY k.win) AS n
    FROM folds k JOIN years ON y <= k.win) WHERE rn <= 3 AND n >= 3),
tail_wins AS (SELECT win FROM folds UNION SELECT y - 1 FROM inner_years),
tail_train AS MATERIALIZED (SELECT k.win, f.* FROM frame f JOIN tail_wins k ON f.catalyst_year <= k.win),
{_tail_sql('d', 'tail_train', p_cols)},
{om.logistic('pf', rows('clinical_failure', 'clinical_failure IS NOT NULL', p_cols), p_cols)},
{om.ridge('cf', rows('realized_car', 'clinical_failure = 1', car_cols), car_cols, 5.0)},
{om.ridge('cs', rows('realized_car', 'clinical_failure = 0', car_cols), car_cols, 5.0)},
inner_rows AS (SELECT y - 1 AS win, f.* FROM frame f JOIN (SELECT DISTINCT y FROM inner_years) ON y = f.catalyst_year),
judged AS MATERIALIZED (SELECT t.catalyst_year, t.realized_car, {_tail_scores_sql('d', p_cols)} FROM inner_rows t {om.joined('d_c', 't')} {om.joined('d_g', 't')}
  WHERE d_c_s.n_rows >= 15 AND round(d_c_s.n_rows * d_c_s.y_mean) >= 2),
per_year AS (SELECT catalyst_year AS y, h.t, avg(-realized_car - {_COST}) AS m FROM judged JOIN (SELECT unnest([{best}]) AS t) h ON p_major_drop >= h.t GROUP BY 1, 2),
per_win AS (SELECT i.win, t, avg(m) AS score FROM inner_years i JOIN per_year USING (y) GROUP BY 1, 2),
thresholds AS (SELECT k.win, CASE WHEN NOT EXISTS (SELECT 1 FROM inner_years i WHERE i.win = k.win) THEN 0.5::DOUBLE
    ELSE coalesce((SELECT t FROM per_win p WHERE p.win = k.win ORDER BY score DESC, t LIMIT 1), {models.THRESHOLDS[0]}::DOUBLE) END AS threshold FROM folds k),
scored AS MATERIALIZED (SELECT t.*, {om.sigmoid(om.line('pf', p_cols, 't'))} AS p_failure, {capped} AS car_failure_pred, {mean_car('cs', -0.003)} AS car_success_pred,
    {_tail_scores_sql('d', p_cols)}, threshold
  FROM test t {om.joined('pf', 't')} {om.joined('cf', 't')} {om.joined('cs', 't')} {om.joined('d_c', 't')} {om.joined('d_g', 't')} JOIN thresholds h ON h.win = t.win),
short AS MATERIALIZED (SELECT *, p_failure * car_failure_pred * company_dependency + (1 - p_failure) * car_success_pred * company_dependency AS expected_car FROM scored)"""


@register("short_walk_forward", f"""WITH RECURSIVE {FRAME}, {_folds_sql(FIRST_TRAIN_END + 1, 15)}, {_short_sql(P_COLS, SHORT_CAR_COLS)}
SELECT catalyst_id, ticker, announcement_date, catalyst_year, CAST(win AS INTEGER) AS train_end_year, CAST(win + 1 AS INTEGER) AS test_year,
  {r('p_failure')} AS p_failure, {r('1 - p_failure')} AS p_success, {r('car_failure_pred')} AS car_failure_pred, {r('car_success_pred')} AS car_success_pred,
  {r('expected_car')} AS expected_car, {r('-expected_car')} AS expected_short_return, {r(f'-expected_car - {_COST}')} AS net_expected_short_return,
  {r('p_major_drop')} AS p_major_drop, {r('p_major_drop * -least(magnitude, 0)')} AS tail_risk_score, {r('threshold')} AS major_drop_threshold,
  {r('company_dependency')} AS company_dependency, {r('realized_car')} AS realized_car, {r(f'-realized_car - {_COST}')} AS realized_short_return,
  clinical_failure, major_negative_event, 'short_wf_' || win AS model_version FROM short""")
def short_walk_forward(spark, sf):
    return _out(models.short_walk_forward(model_frame(spark, sf), P_COLS, SHORT_CAR_COLS, FIRST_TRAIN_END + 1))


@register("expected_car", f"""WITH RECURSIVE {FRAME}, {_one_window_sql('true', 'true')}, {om.expected_car('m', 'train', '', P_COLS, CAR_COLS, 'test')}
SELECT count(*) AS n, CAST(sum(clinical_success) AS BIGINT) AS n_success, {r('avg(realized_car)')} AS realized_car_mean, {r('avg(expected_car)')} AS expected_car_mean,
  {r('corr(expected_car, realized_car)')} AS correlation, count(*) FILTER (WHERE market_features_point_in_time) AS market_verified,
  count(*) FILTER (WHERE trial_features_point_in_time) AS trial_verified FROM m""")
def expected_car(spark, sf):
    """In-sample fit with its monitoring metrics."""
    df = model_frame(spark, sf)
    m = models.fit_expected_car(df, P_COLS, CAR_COLS)
    pred = models.predict_expected_car(df, m)
    return _out(pred.agg(
        F.count(F.lit(1)).alias("n"), F.sum("clinical_success").alias("n_success"), F.avg("realized_car").alias("realized_car_mean"),
        F.avg("expected_car").alias("expected_car_mean"), metrics.correlation("expected_car", "realized_car").alias("correlation"),
        F.count(F.when(F.col("market_features_point_in_time"), 1)).alias("market_verified"),
        F.count(F.when(F.col("trial_features_point_in_time"), 1)).alias("trial_verified")))


@register("base_rate_model", f"""WITH {LEDGER}, cal AS (SELECT avg(clinical_success) AS p, avg(realized_car) FILTER (WHERE clinical_success = 1) AS s,
    avg(realized_car) FILTER (WHERE clinical_success = 0) AS f FROM ledger WHERE test_year < 1999)
SELECT catalyst_id, {r('coalesce(CASE WHEN catalyst_id % 3 <> 0 THEN p_failure END, p)')} AS p_success,
  {r('coalesce(CASE WHEN catalyst_id % 3 <> 0 THEN p_failure END, p) * s + (1 - coalesce(CASE WHEN catalyst_id % 3 <> 0 THEN p_failure END, p)) * f')} AS expected_car
FROM ledger, cal WHERE test_year >= 1999""")
def base_rate_model(spark, sf):
    led = inputs.ledger(spark, sf).withColumn("rate", F.when(F.col("catalyst_id") % 3 != 0, F.col("p_failure")))
    out = models.predict_base_rate(led.filter("test_year >= 1999"), led.filter("test_year < 1999"), "rate")
    return _out(out.select("catalyst_id", "p_success", "expected_car"))


_SETS = {name: features.resolve_features(name) for name in ab.EXPECTED_CAR_SETS}
_BASE_RATE = "coalesce(wong_pos_rate, p)"


def _base_rate_sql(name: str, rows: str, calibration: str) -> str:
    return f"""{name}_c AS (SELECT avg(clinical_success) AS p, avg(realized_car) FILTER (WHERE clinical_success = 1) AS s,
    avg(realized_car) FILTER (WHERE clinical_success = 0) AS f FROM {calibration}),
{name} AS (SELECT x.*, {_BASE_RATE} AS p_success, {_BASE_RATE} * s + (1 - {_BASE_RATE}) * f AS expected_car FROM {rows} x, {name}_c)"""


def _ablation_sql() -> str:
    fits, out = [], []
    for tag, split in (("i", "in_sample"), ("h", "locked_holdout")):
        for i, (name, cols) in enumerate(_SETS.items()):
            fits.append(om.expected_car(f"{tag}{i}", f"{tag}_train", "", cols, CAR_COLS, f"{tag}_test"))
            out.append((f"{tag}{i}", name, split))
        fits.append(_base_rate_sql(f"{tag}b", f"{tag}_test", f"{tag}_train"))
        out.append((f"{tag}b", "base_rate", split))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS model, '{split}' AS split, expected_car, realized_car FROM {cte}" for cte, name, split in out)
    return f"""WITH RECURSIVE {FRAME}, i_train AS MATERIALIZED (SELECT 0 AS win, * FROM frame), i_test AS (SELECT * FROM i_train),
h_train AS MATERIALIZED (SELECT 0 AS win, * FROM frame WHERE catalyst_year < {HOLDOUT[0]}),
h_test AS MATERIALIZED (SELECT 0 AS win, * FROM frame WHERE catalyst_year BETWEEN {HOLDOUT[0]} AND {HOLDOUT[1]}),
{(","+chr(10)).join(fits)}
SELECT model, split, count(*) AS n, {r('corr(expected_car, realized_car)')} AS corr, {r('avg(expected_car)')} AS mean_expected,
  {r('avg(realized_car)')} AS mean_realized FROM ({rows}) GROUP BY ALL"""


@register("ablation", _ablation_sql())
def ablation(spark, sf):
    """Four feature sets and the base rate, in sample and on the locked years."""
    df = model_frame(spark, sf)
    held = (df.filter(F.col("catalyst_year") < HOLDOUT[0]), df.filter(F.col("catalyst_year").between(*HOLDOUT)))
    parts = []
    for split, (train, test) in {"in_sample": (df, df), "locked_holdout": held}.items():
        scored = ab.scored_sets(test, ab.expected_car_models(train, _SETS, CAR_COLS), ["realized_car"]).drop("p_success")
        base = models.predict_base_rate(test, train, "wong_pos_rate").select("realized_car", F.lit("base_rate").alias("model"), "expected_car")
        parts.append(scored.unionByName(base).withColumn("split", F.lit(split)))
    return _out(ab.summary(reduce(DataFrame.unionByName, parts), ["model", "split"]))


_SHORT_SETS = {name: features.resolve_features(name) for name in ab.SHORT_SETS}


def _short_ablation_sql(names) -> str:
    """Every set is fitted in a subquery of its own."""
    def one(name):
        cols = _SHORT_SETS[name]
        picks = " UNION ALL ".join(
            f"""SELECT 'short_top_{f}pct' AS strategy, rsr FROM (SELECT rsr, row_number() OVER (PARTITION BY win ORDER BY nesr DESC, catalyst_id) AS rn,
    count(*) OVER (PARTITION BY win) AS cnt FROM s) WHERE rn <= greatest(1, ceil(cnt * 0.{f}::DOUBLE))""" for f in (10, 20))
        return f"""SELECT '{name}' AS feature_set, * FROM (WITH RECURSIVE {_short_sql(cols, cols)},
s AS (SELECT *, -expected_car - {_COST} AS nesr, -realized_car - {_COST} AS rsr FROM short) {picks})"""

    return f"""WITH RECURSIVE {FRAME}, {_folds_sql(FIRST_TRAIN_END + 1, 15)}
SELECT feature_set, strategy, count(*) AS n, {r('avg(rsr)')} AS mean_short_return, {r('avg(CASE WHEN rsr > 0 THEN 1e0 ELSE 0e0 END)')} AS hit_rate, {r('min(rsr)')} AS worst
FROM ({" UNION ALL ".join(one(n) for n in names)}) GROUP BY ALL"""


@register("short_ablation", _short_ablation_sql(ab.SHORT_SETS))
def short_ablation(spark, sf):
    """Eight feature sets by two short strategies over the walk-forward."""
    sets = {name: (cols, cols) for name, cols in _SHORT_SETS.items()}
    return _out(ab.short_ablation(model_frame(spark, sf), sets, FIRST_TRAIN_END + 1))


_AS_OF = f"{HOLDOUT[0]}-01-01"


@register("ranking_report", f"""WITH RECURSIVE {FRAME}, folds AS (SELECT {FIRST_TRAIN_END} AS win),
w_train AS MATERIALIZED (SELECT {FIRST_TRAIN_END} AS win, * FROM frame WHERE catalyst_year <= {FIRST_TRAIN_END}),
w_test AS MATERIALIZED (SELECT {FIRST_TRAIN_END} AS win, * FROM frame WHERE catalyst_year = {FIRST_TRAIN_END + 1}),
{_one_window_sql(f'catalyst_year < {HOLDOUT[0]}', f"announcement_date IS NULL OR announcement_date >= DATE '{_AS_OF}'")},
{om.expected_car('w', 'w_train', '', P_COLS, CAR_COLS, 'w_test')},
{om.expected_car('m', 'train', '', P_COLS, CAR_COLS, 'test')},
res AS (SELECT abs(realized_car - expected_car) AS a, row_number() OVER (ORDER BY abs(realized_car - expected_car)) - 1 AS i, count(*) OVER () AS n FROM w),
q AS (SELECT a AS q FROM res WHERE i = ceil(least(1e0, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1))),
x AS MATERIALIZED (SELECT *, expected_car * company_dependency AS adj, (expected_car - q) * company_dependency AS lo, (expected_car + q) * company_dependency AS hi FROM m, q),
pct AS (SELECT *, (rank() OVER (ORDER BY adj) + (count(*) OVER (PARTITION BY adj) - 1) / 2e0) / count(*) OVER () AS pc,
    row_number() OVER (ORDER BY adj DESC, catalyst_id) AS "rank" FROM x)
SELECT "rank", catalyst_id, ticker, {r('p_success')} AS p_success, {r('expected_car')} AS expected_car, {r('adj')} AS expected_car_exposure_adj, {r('lo')} AS lo, {r('hi')} AS hi,
  market_features_point_in_time AND trial_features_point_in_time AND company_features_point_in_time AS point_in_time_verified,
  CASE WHEN pc >= 0.90::DOUBLE THEN 'STRONG LONG' WHEN pc >= 0.75::DOUBLE THEN 'LONG' WHEN pc <= 0.10::DOUBLE THEN 'STRONG SHORT'
    WHEN pc <= 0.25::DOUBLE THEN 'SHORT' ELSE 'NO TRADE' END AS signal,
  CASE WHEN lo > 0 THEN 'CONFIDENT LONG' WHEN hi < 0 THEN 'CONFIDENT SHORT' ELSE 'UNCERTAIN' END AS confidence_signal,
  'strict_point_in_time_sanitized' AS model_training_policy, 'export' AS interval_source FROM pct""")
def ranking_report(spark, sf):
    """Prospective ranking: provenance check, exposure, interval from exported out-of-sample residuals, signals."""
    df = model_frame(spark, sf)
    train = df.filter(F.col("catalyst_year") < HOLDOUT[0])
    m = models.fit_expected_car(train, P_COLS, CAR_COLS)
    wf = models.walk_forward(train, P_COLS, CAR_COLS, FIRST_TRAIN_END)
    fitted = models.predict_expected_car(train, m)
    in_sample, ledger = (
        x.select(F.col("catalyst_id").alias("id"), (F.col("realized_car") - F.col("expected_car")).alias("residual")) for x in (fitted, inputs.ledger(spark, sf)))
    sources = [("export", ranking.export_residuals(wf)), ("ledger", ledger), ("in_sample", in_sample)]
    ranked = ranking.rank(df, m, sources, _AS_OF)
    verified = F.col("structured_features_point_in_time") & F.col("company_features_point_in_time")
    return _out(ranked.select(
        "rank", "catalyst_id", "ticker", "p_success", "expected_car", "expected_car_exposure_adj", "lo", "hi", verified.alias("point_in_time_verified"),
        "signal", "confidence_signal", "model_training_policy", "interval_source"))


def _docs(spark, sf):
    d, l = inputs.table(spark, sf, "documents"), inputs.table(spark, sf, "labels")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return d.join(l, "doc_id", "left").select(
        "doc_id", F.col("quality").alias("label"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"), (F.col("n_chars") / words).alias("chars_per_word"),
        F.regexp_count("text", F.lit("\n")).cast("double").alias("n_lines"))


DOC_NUM, DOC_CAT = ["n_chars", "n_words", "chars_per_word", "n_lines"], ["lang"]
#: The languages of the documents; a missing one reads as the most frequent.
_LANGS = ("de", "en", "es", "fr")
_HOT = [f"is_{x}" for x in _LANGS]
_DOCS_SQL = f"""docs0 AS (SELECT d.doc_id, l.quality AS label, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
    CAST(len(string_split_regex(trim(d.text), '\\s+')) AS DOUBLE) AS n_words, CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS n_lines
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
docs AS MATERIALIZED (SELECT *, n_chars / n_words AS chars_per_word, {', '.join(f"CASE WHEN lang = '{x}' THEN 1e0 ELSE 0e0 END AS is_{x}" for x in _LANGS)} FROM docs0)"""


def _quality_sql(q: str, y: str = "label") -> str:
    loss = f"CASE WHEN {y} = 1 THEN -ln(least(greatest({q}, 1e-6), 1 - 1e-6)) ELSE -ln(1 - least(greatest({q}, 1e-6), 1 - 1e-6)) END"
    return f"count(*) AS n, CAST(sum({y}) AS BIGINT) AS n_events, {r(f'avg(pow({q} - {y}, 2))')} AS brier, {r(f'avg({loss})')} AS log_loss"


def _doc_fit_sql(name: str, where: str, nums, hot, balanced: bool = True, win: str = "0") -> str:
    cols = [*nums, *hot]
    return om.logistic(name, f"SELECT {win} AS win, label AS y, {', '.join(cols)} FROM docs WHERE label IS NOT NULL AND {where}", cols, balanced, hot)


#: Isotonic calibration as the max-min formula: the fitted value of a point is the greatest, over starts before it, of the least mean up to an
#: end after it; predictions interpolate between points and stop at the outer ones.
_CLASSIFIER_SQL = f"""WITH RECURSIVE {_DOCS_SQL}, {_doc_fit_sql('c', 'doc_id % 10 < 6', DOC_NUM, _HOT)},
scored AS MATERIALIZED (SELECT t.doc_id, t.label, {om.sigmoid(om.line('c', [*DOC_NUM, *_HOT], 't'))} AS p_raw FROM (SELECT 0 AS win, * FROM docs) t {om.joined('c', 't')}),
pts AS MATERIALIZED (SELECT p_raw AS x, avg(label) AS y, count(*) AS w, row_number() OVER (ORDER BY p_raw) AS i FROM scored
  WHERE label IS NOT NULL AND doc_id % 10 IN (6, 7) GROUP BY 1),
cum AS (SELECT i, x, sum(y * w) OVER (ORDER BY i) AS s, sum(w) OVER (ORDER BY i) AS n, y * w AS yw, w FROM pts),
spans AS (SELECT a.i AS a, b.i AS b, (b.s - a.s + a.yw) / (b.n - a.n + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
least_up AS (SELECT p.i, s.a, min(s.m) AS m FROM pts p JOIN spans s ON s.a <= p.i AND s.b >= p.i GROUP BY 1, 2),
iso AS MATERIALIZED (SELECT i, any_value(x) AS x, max(m) AS v FROM least_up JOIN pts USING (i) GROUP BY i),
near AS (SELECT s.*, (SELECT max(i) FROM iso WHERE iso.x <= s.p_raw) AS lo, (SELECT min(i) FROM iso WHERE iso.x >= s.p_raw) AS hi FROM scored s)
SELECT doc_id, label, {r('p_raw')} AS p_raw, {r('CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR lo = hi THEN l.v ELSE l.v + (h.v - l.v) * (p_raw - l.x) / (h.x - l.x) END')} AS p
FROM near LEFT JOIN iso l ON l.i = lo LEFT JOIN iso h ON h.i = hi"""


@register("classifier", _CLASSIFIER_SQL)
def classifier_query(spark, sf):
    """Temporal split, one-hot categories, balanced logistic and isotonic calibration; scores every row."""
    df = stable(_docs(spark, sf))
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    labelled = df.filter("label is not null").withColumn("split", split)
    m = classifier.fit(labelled.filter("split = 'train'"), labelled.filter("split = 'validation'"), DOC_NUM, DOC_CAT, "label")
    return _out(classifier.score(df, m, ["doc_id", "label"]))


_FOLD = "(doc_id * 48271 + 12345) % 2147483647 % 5"


@register("classifier_cv", f"""WITH RECURSIVE {_DOCS_SQL}, k AS (SELECT unnest(range(5)) AS win),
{om.logistic('c', f"SELECT win, label AS y, {', '.join([*DOC_NUM, *_HOT])} FROM docs JOIN k ON {_FOLD} <> win WHERE label IS NOT NULL", [*DOC_NUM, *_HOT], True, _HOT)},
oof AS MATERIALIZED (SELECT t.label, {om.sigmoid(om.line('c', [*DOC_NUM, *_HOT], 't'))} AS p
  FROM (SELECT {_FOLD} AS win, * FROM docs WHERE label IS NOT NULL) t {om.joined('c', 't')}),
ranked AS (SELECT label AS y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM oof)
SELECT {_quality_sql('p')}, (SELECT {r('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)))')} FROM ranked) AS roc_auc FROM oof""")
def classifier_cv(spark, sf):
    """Five folds by id, out-of-fold scores and their metrics."""
    df = stable(_docs(spark, sf).filter("label is not null"))
    fold = (F.col("doc_id") * 48271 + 12345) % 2147483647 % 5
    oof = stable(classifier.cross_validate(df, DOC_NUM, DOC_CAT, "label", "doc_id", 5, fold))
    s = metrics.probability_scores(oof, "label", "p")
    auc = metrics.roc_auc(oof, "label", "p").select("roc_auc").scalar()
    return _out(s.withColumn("roc_auc", auc))


@register("exploratory_logistic", f"""WITH RECURSIVE {_DOCS_SQL}, coded AS MATERIALIZED (SELECT label, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'UNKNOWN')) - 1 AS DOUBLE) AS lang_code,
    CAST(dense_rank() OVER (ORDER BY coalesce(source, 'UNKNOWN')) - 1 AS DOUBLE) AS source_code FROM docs WHERE label IS NOT NULL),
{om.logistic('c', "SELECT 0 AS win, label AS y, lang_code, source_code FROM coded", ['lang_code', 'source_code'], False)},
p AS (SELECT t.label, {om.sigmoid(om.line('c', ['lang_code', 'source_code'], 't'))} AS p FROM (SELECT 0 AS win, * FROM coded) t {om.joined('c', 't')})
SELECT {_quality_sql('p')} FROM p""")
def exploratory_logistic(spark, sf):
    """Logistic on ordinal codes of the categories, in-sample Brier score."""
    df = stable(_docs(spark, sf).filter("label is not null"))
    coded = classifier.ordinal_codes(df, ["lang", "source"])
    m = models.fit_logistic(coded, ["lang_code", "source_code"], "label", balanced=False)
    return _out(metrics.probability_scores(coded.withColumn("p", m.probability()), "label", "p"))


_HOLDOUT_SETS = {"market_only": CAR_COLS, "market_plus_trial": P_COLS, "trial_only": features.resolve_features("trial_only")}


def _holdout_sql() -> str:
    fits = [om.expected_car(f"h{i}", "train", "", cols, CAR_COLS, "test") for i, cols in enumerate(_HOLDOUT_SETS.values())]
    rows = [(f"h{i}", name) for i, name in enumerate(_HOLDOUT_SETS)] + [("hb", "base_rate"), ("hm", "training_mean")]
    keep = "clinical_success, realized_car, p_success, expected_car"
    return f"""WITH RECURSIVE {FRAME}, {_one_window_sql(f'catalyst_year < {HOLDOUT[0]}', f'catalyst_year BETWEEN {HOLDOUT[0]} AND {HOLDOUT[1]}')},
{(","+chr(10)).join(fits)},
c AS (SELECT avg(clinical_success) AS p, avg(realized_car) FILTER (WHERE clinical_success = 1) AS s, avg(realized_car) FILTER (WHERE clinical_success = 0) AS f FROM train),
g AS (SELECT indication, avg(clinical_success) AS v FROM train GROUP BY 1),
hb AS (SELECT t.*, coalesce(v, p) AS p_success, coalesce(v, p) * s + (1 - coalesce(v, p)) * f AS expected_car FROM c, test t LEFT JOIN g ON g.indication = t.indication),
hm AS (SELECT t.*, p AS p_success, p * s + (1 - p) * f AS expected_car FROM c, test t),
scored AS (SELECT *, least(greatest(p_success, 1e-6), 1 - 1e-6) AS q FROM ({" UNION ALL ".join(f"SELECT '{n}' AS model, {keep} FROM {t}" for t, n in rows)}))
SELECT model, count(*) AS n, {r('CASE WHEN stddev_pop(expected_car) > 0 AND count(DISTINCT expected_car) > 1 THEN corr(expected_car, realized_car) END')} AS corr,
  {r('avg(expected_car)')} AS mean_expected, {r('avg(realized_car)')} AS mean_realized, {r('avg(pow(p_success - clinical_success, 2))')} AS brier,
  {r('avg(CASE WHEN clinical_success = 1 THEN -ln(q) ELSE -ln(1 - q) END)')} AS log_loss FROM scored GROUP BY 1"""


@register("holdout_models", _holdout_sql())
def holdout_models(spark, sf):
    """Five models on the locked years: three feature sets, the base rate of the indication and the training mean."""
    df = model_frame(spark, sf)
    train, test = df.filter(F.col("catalyst_year") < HOLDOUT[0]), df.filter(F.col("catalyst_year").between(*HOLDOUT))
    keep = ["catalyst_id", "clinical_success", "realized_car"]
    parts = [ab.scored_sets(test, ab.expected_car_models(train, _HOLDOUT_SETS, CAR_COLS), keep)]
    rates = train.groupBy("indication").agg(F.avg("clinical_success").alias("_rate"))
    none = test.withColumn("_none", F.lit(None).cast("double"))
    for name, rows, rate in (("base_rate", test.join(rates, "indication", "left"), "_rate"), ("training_mean", none, "_none")):
        parts.append(models.predict_base_rate(rows, train, rate).select(*keep, F.lit(name).alias("model"), "p_success", "expected_car"))
    scored = stable(reduce(DataFrame.unionByName, parts))
    brier = metrics.probability_scores(scored, "clinical_success", "p_success", ["model"]).select("model", "brier", "log_loss")
    return _out(ab.summary(scored, ["model"]).join(brier, "model"))


def _sets_sql() -> str:
    sets = {"size": (["n_chars", "n_words"], []), "shape": (["chars_per_word", "n_lines"], _HOT)}
    fits = [_doc_fit_sql(name, "doc_id % 10 < 7", nums, hot) for name, (nums, hot) in sets.items()]
    rows = [f"""SELECT '{name}' AS feature_set, t.label, {om.sigmoid(om.line(name, [*nums, *hot], 't'))} AS p
  FROM (SELECT 0 AS win, * FROM docs WHERE label IS NOT NULL AND doc_id % 10 >= 7) t {om.joined(name, 't')}""" for name, (nums, hot) in sets.items()]
    return f"""WITH RECURSIVE {_DOCS_SQL}, {(","+chr(10)).join(fits)}, p AS ({" UNION ALL ".join(rows)})
SELECT feature_set, {_quality_sql('p')}, NULL::VARCHAR AS failure FROM p GROUP BY 1
UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, 'missing columns: nope'"""


@register("classifier_sets", _sets_sql())
def classifier_sets(spark, sf):
    """Several feature sets in one run: test metrics of those that fit, the reason for those that do not."""
    df = stable(_docs(spark, sf).filter("label is not null"))
    part = F.pmod(F.col("doc_id"), F.lit(10))
    train, test = df.filter(part < 7), df.filter(part >= 7)
    sets = {"size": (["n_chars", "n_words"], []), "shape": (["chars_per_word", "n_lines"], ["lang"]), "absent": (["nope"], [])}
    fitted, failed = classifier.fit_sets(train, None, sets, "label")
    none = test.select("label").limit(0).withColumns({"p": F.lit(None).cast("double"), "feature_set": F.lit("")})
    scored = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        classifier.score(test, m, ["label"]).withColumn("feature_set", F.lit(n)) for n, m in fitted.items()], none)
    s = metrics.probability_scores(scored, "label", "p", ["feature_set"]).withColumn("failure", F.lit(None).cast("string"))
    for name, reason in failed.items():
        s = s.unionByName(s.limit(0).unionByName(
            spark.createDataFrame([(name, reason)], "feature_set string, failure string"), allowMissingColumns=True))
    return _out(s)
