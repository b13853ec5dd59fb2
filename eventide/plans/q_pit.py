"""Queries: point-in-time cutoffs, as-of joins, resolution of tickers and providers, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions.rounding import rnd
from eventide.operators import asof, audits, cutoffs, eventstudy, lookup, series
from eventide.plans import inputs
from eventide.plans.oracle_base import ALIGNED, BARS, BENCH, CUTS, EVTS, FACTS, RETURNS, r
from eventide.plans.q_core import _MATCHED, _aligned, _study_events

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def s(*cols):
    return [F.col(c).cast("string").alias(c) for c in cols]


def S(*cols):
    return ", ".join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)


@register("trading_cutoffs", f"""WITH {CUTS} SELECT catalyst_id, timing, {S('trading_cutoff_date')},
  CAST(announcement_date + 1 AS VARCHAR) AS first_trading_day_after,
  CASE timing WHEN 'AMC' THEN 'MEDIUM' WHEN 'BMO' THEN 'HIGH' ELSE 'LOW' END AS execution_confidence FROM cuts""")
def trading_cutoffs(spark, sf):
    df = cutoffs.trading_cutoffs(inputs.catalysts(spark, sf), "announcement_date", "timing")
    return df.select("catalyst_id", "timing", *s("trading_cutoff_date", "first_trading_day_after"),
                     "execution_confidence")


def _with_cutoff(spark, sf):
    return inputs.catalysts_with_cutoffs(spark, sf).withColumn("cutoff", cutoffs.feature_cutoff())


@register("feature_cutoff", f"WITH {CUTS} SELECT catalyst_id, {S('cutoff')} FROM cuts WHERE cutoff IS NOT NULL")
def feature_cutoff(spark, sf):
    return _with_cutoff(spark, sf).filter("cutoff is not null").select("catalyst_id", *s("cutoff"))


_SNAP = CUTS + """,
snap AS (SELECT *, CAST(cutoff AS TIMESTAMP) + to_hours(CAST(catalyst_id % 49 - 24 AS INTEGER)) AS trial_observed,
    cutoff + CAST(catalyst_id % 5 - 2 AS INTEGER) AS exposure_as_of FROM cuts)"""


def _snapshots(spark, sf):
    key = F.col("catalyst_id")
    hours = F.make_dt_interval(hours=(key % 49 - 24).cast("int"))
    return _with_cutoff(spark, sf).withColumns({
        "trial_observed": F.col("cutoff").cast("timestamp") + hours,
        "exposure_as_of": F.date_add("cutoff", (key % 5 - 2).cast("int")),
    })


@register("pit_mask", f"""WITH {_SNAP} SELECT catalyst_id, coalesce(observed_at <= cutoff, false) AS market_ok,
  coalesce(trial_observed <= CAST(cutoff AS TIMESTAMP), false) AS trial_ok FROM snap""")
def pit_mask(spark, sf):
    df = _snapshots(spark, sf)
    return df.select("catalyst_id",
                     cutoffs.point_in_time(F.col("observed_at"), F.col("cutoff")).alias("market_ok"),
                     cutoffs.point_in_time(F.col("trial_observed"), F.col("cutoff")).alias("trial_ok"))


@register("pit_sanitize", f"""WITH {_SNAP} SELECT catalyst_id, coalesce(observed_at <= cutoff, false) AS market_flag,
  CASE WHEN observed_at <= cutoff THEN amount END AS amount,
  CASE WHEN observed_at <= cutoff THEN acctbal END AS acctbal FROM snap""")
def pit_sanitize(spark, sf):
    df = cutoffs.sanitize_family(_snapshots(spark, sf), ["amount", "acctbal", "absent_column"],
                                 "observed_at", "cutoff", "market_flag")
    return df.select("catalyst_id", "market_flag", "amount", "acctbal")


@register("latest_safe_date", f"""WITH {_SNAP} SELECT catalyst_id, CAST(greatest(
    CASE WHEN observed_at <= cutoff THEN observed_at END, CASE WHEN exposure_as_of <= cutoff THEN exposure_as_of END,
    CASE WHEN trial_observed <= CAST(cutoff AS TIMESTAMP) THEN CAST(trial_observed AS DATE) END) AS VARCHAR)
  AS feature_as_of_date FROM snap""")
def latest_safe_date(spark, sf):
    df = _snapshots(spark, sf)
    fam = {"m": "observed_at", "e": "exposure_as_of", "t": "trial_observed"}
    for flag, obs in fam.items():
        df = df.withColumn(flag, cutoffs.point_in_time(F.col(obs), F.col("cutoff")))
    return df.select("catalyst_id", cutoffs.latest_safe_date(fam).cast("string").alias("feature_as_of_date"))


@register("labelled_as_of", f"""WITH {EVTS} SELECT catalyst_id FROM evts WHERE clinical_success IS NOT NULL
  AND amount IS NOT NULL AND announcement_date >= DATE '1998-01-01'""")
def labelled_as_of(spark, sf):
    ev = inputs.catalysts(spark, sf)
    cond = cutoffs.labelled_only("clinical_success", "amount") & (
        F.col("announcement_date") >= F.lit("1998-01-01").cast("date"))
    return ev.filter(cond).select("catalyst_id")


@register("locked_holdout", f"""WITH {EVTS} SELECT catalyst_id FROM evts WHERE announcement_date < DATE '2000-01-01'""")
def locked_holdout(spark, sf):
    return inputs.catalysts(spark, sf).filter(
        cutoffs.before_locked_holdout("announcement_date", "2000-01-01")).select("catalyst_id")


@register("holdout_split", f"""WITH {EVTS} SELECT CASE WHEN year(announcement_date) < 1999 THEN 'train'
  WHEN year(announcement_date) BETWEEN 1999 AND 2000 THEN 'test' END AS split, count(*) AS n FROM evts GROUP BY 1""")
def holdout_split(spark, sf):
    sp = cutoffs.holdout_split(F.year("announcement_date"), 1999, 2000).alias("split")
    return inputs.catalysts(spark, sf).groupBy(sp).agg(F.count(F.lit(1)).alias("n"))


@register("effective_public_date", f"""WITH {_SNAP} SELECT catalyst_id,
  CAST(least(observed_at, exposure_as_of) AS VARCHAR) AS effective_date FROM snap""")
def effective_public_date(spark, sf):
    d = cutoffs.effective_public_date("observed_at", "exposure_as_of").cast("string")
    return _snapshots(spark, sf).select("catalyst_id", d.alias("effective_date"))


_AUDIT = _SNAP + """,
findings AS (
  SELECT catalyst_id, 'market_feature_after_cutoff' AS "check", 'FAIL' AS severity,
    CAST(observed_at AS TIMESTAMP) AS observed_at, cutoff FROM snap WHERE observed_at > cutoff
  UNION ALL SELECT catalyst_id, 'exposure_after_cutoff', 'FAIL', CAST(exposure_as_of AS TIMESTAMP), cutoff
    FROM snap WHERE exposure_as_of > cutoff
  UNION ALL SELECT catalyst_id, 'fundamental_filed_after_cutoff', 'FAIL', CAST(cutoff + 1 AS TIMESTAMP), cutoff
    FROM snap WHERE catalyst_id % 9 = 0
  UNION ALL SELECT catalyst_id, 'trial_snapshot_observed_after_cutoff', 'UNVERIFIED', trial_observed, cutoff
    FROM snap WHERE CAST(trial_observed AS DATE) > cutoff
  UNION ALL SELECT catalyst_id, 'trial_first_posted_after_cutoff', 'FAIL', CAST(announcement_date AS TIMESTAMP), cutoff
    FROM snap WHERE announcement_date > cutoff)"""


def _findings(spark, sf):
    df = _snapshots(spark, sf)
    filed = F.date_add("cutoff", F.when(F.col("catalyst_id") % 9 == 0, 1).otherwise(0))
    obs = [
        ("market_feature_after_cutoff", "FAIL", "observed_at"),
        ("exposure_after_cutoff", "FAIL", "exposure_as_of"),
        ("fundamental_filed_after_cutoff", "FAIL", "filed"),
        ("trial_snapshot_observed_after_cutoff", "UNVERIFIED", "trial_observed"),
        ("trial_first_posted_after_cutoff", "FAIL", "announcement_date"),
    ]
    src = df.withColumn("filed", filed)
    frames = [(c, sev, src.select("catalyst_id", F.col(o).cast("timestamp").alias("observed_at")))
              for c, sev, o in obs]
    return audits.cutoff_violations(df.select("catalyst_id", F.col("cutoff").alias("cutoff_date")), frames)


@register("pit_audit", f"""WITH {_AUDIT} SELECT catalyst_id, "check", severity,
  strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, CAST(cutoff AS VARCHAR) AS cutoff_date FROM findings""")
def pit_audit(spark, sf):
    return _findings(spark, sf).select(
        "catalyst_id", "check", "severity",
        F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), *s("cutoff_date"))


@register("pit_audit_summary", f"""WITH {_AUDIT}, l AS (SELECT catalyst_id, severity, "check" FROM findings
  UNION ALL SELECT catalyst_id, severity, 'ALL' FROM findings)
SELECT "check", count(*) FILTER (WHERE severity = 'FAIL') AS violations,
  count(*) FILTER (WHERE severity = 'UNVERIFIED') AS unverified, count(DISTINCT catalyst_id) AS affected_catalysts
FROM l GROUP BY 1""")
def pit_audit_summary(spark, sf):
    return audits.audit_summary(_findings(spark, sf))


@register("market_feature_check", f"""WITH {CUTS}, c AS (SELECT catalyst_id, observed_at,
    coalesce(entry_cutoff_date, announcement_date) AS cut FROM cuts),
x AS (SELECT catalyst_id, CASE WHEN observed_at IS NULL THEN 'market_features_exist'
    ELSE 'market_features_before_cutoff' END AS check_type,
  CASE WHEN observed_at IS NULL THEN 'no features' WHEN observed_at > cut THEN
    'as_of ' || CAST(observed_at AS VARCHAR) || ' > cutoff ' || CAST(cut AS VARCHAR) END AS detail FROM c)
SELECT catalyst_id, check_type, detail IS NULL AS passed, detail FROM x""")
def market_feature_check(spark, sf):
    df = _with_cutoff(spark, sf)
    feats = df.filter("observed_at is not null").select("catalyst_id", F.col("observed_at").alias("as_of_date"))
    return audits.market_feature_check(feats, df.select("catalyst_id", "entry_cutoff_date", "announcement_date"))


_PROG = """progs AS (SELECT o_orderkey AS program_id,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + 60 END AS t0_date FROM orders),
pubs AS (SELECT l_orderkey AS program_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_partkey || '-' || l_suppkey || '-' || l_linenumber AS study_name,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS publication_date,
    CASE WHEN l_quantity > 10 THEN CAST(l_shipdate AS DATE) - l_linenumber END AS online_first_date
  FROM lineitem WHERE l_linestatus = 'F')"""


def _programs(spark, sf):
    o = inputs.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("program_id"),
                    F.when(F.col("o_orderkey") % 17 != 0, F.date_add(F.to_date("o_orderdate"), 60)).alias("t0_date"))


def _publications(spark, sf):
    li = inputs.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F")
    ship = F.to_date("l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("program_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("study_no"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("study_name"),
        F.when(F.col("l_linenumber") != 7, ship).alias("publication_date"),
        F.when(F.col("l_quantity") > 10, F.date_sub(ship, F.col("l_linenumber"))).alias("online_first_date"),
    )


@register("leakage_audit", f"""WITH {_PROG}, v AS (SELECT p.program_id, row_number() OVER (PARTITION BY p.program_id
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, detail) AS rn, detail FROM (
  SELECT q.*, CASE WHEN eff IS NULL THEN 'study ' || study_name || ': missing publication date'
    WHEN eff > t0_date THEN 'study ' || study_name || ': effective date ' || CAST(eff AS VARCHAR) || ' > t0 '
      || CAST(t0_date AS VARCHAR) END AS detail
  FROM (SELECT pubs.*, t0_date, least(publication_date, online_first_date) AS eff
    FROM pubs JOIN progs USING (program_id)) q) p WHERE detail IS NOT NULL)
SELECT program_id, 't0_defined' AS check_type, t0_date IS NOT NULL AS passed,
  CASE WHEN t0_date IS NULL THEN 't0_date not set' END AS violation_detail FROM progs
UNION ALL SELECT progs.program_id, 'publication_after_t0', detail IS NULL, detail
FROM progs LEFT JOIN (SELECT * FROM v WHERE rn = 1) v ON v.program_id = progs.program_id""")
def leakage_audit(spark, sf):
    return audits.leakage_audit(_programs(spark, sf), _publications(spark, sf))


@register("temporal_split_check", f"""WITH {_PROG}, x AS (SELECT program_id, t0_date, year(t0_date) AS y,
    CASE WHEN program_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM progs),
z AS (SELECT program_id, CASE WHEN y IS NULL THEN 'missing t0 year'
  WHEN split = 'train' AND y > 1998 THEN 'train split but t0 year ' || y || ' > 1998'
  WHEN split = 'test' AND y < 1999 THEN 'test split but t0 year ' || y || ' < 1999' END AS violation_detail FROM x)
SELECT program_id, 'temporal_split_integrity' AS check_type, violation_detail IS NULL AS passed, violation_detail
FROM z""")
def temporal_split_check(spark, sf):
    p = _programs(spark, sf).withColumn("split", F.when(F.col("program_id") % 2 == 0, "train").otherwise("test"))
    return audits.temporal_split_check(p, "split", 1998, 1999)


@register("asof_forward", f"""WITH {BARS}, {EVTS} SELECT catalyst_id, (SELECT CAST(min(b.date) AS VARCHAR) FROM bars b
  WHERE b.ticker = e.ticker AND b.date >= e.announcement_date) AS session_date FROM evts e""")
def asof_forward(spark, sf):
    ev = inputs.catalysts(spark, sf).select("catalyst_id", "ticker", "announcement_date")
    out = asof.forward_session(ev, inputs.bars(spark, sf), "ticker", "announcement_date", "date", "session_date")
    return out.select("catalyst_id", *s("session_date"))


@register("asof_nearest", f"""WITH {BARS}, {EVTS}, k AS (SELECT DISTINCT ticker, announcement_date AS d FROM evts),
c AS (SELECT k.ticker, k.d, (SELECT min(b.date) FROM bars b WHERE b.ticker = k.ticker AND b.date >= k.d) AS nx,
  (SELECT max(b.date) FROM bars b WHERE b.ticker = k.ticker AND b.date <= k.d) AS pv FROM k)
SELECT catalyst_id, CAST(CASE WHEN nx IS NULL THEN pv WHEN pv IS NULL THEN nx WHEN nx - d <= d - pv THEN nx ELSE pv END
  AS VARCHAR) AS session_date FROM evts JOIN c ON c.ticker = evts.ticker AND c.d = evts.announcement_date""")
def asof_nearest(spark, sf):
    ev = inputs.catalysts(spark, sf).select("catalyst_id", "ticker", "announcement_date")
    out = asof.nearest_session(ev, inputs.bars(spark, sf), "ticker", "announcement_date", "date", "session_date")
    return out.select("catalyst_id", *s("session_date"))


_FIELDS = {"cash": ("purchase", "click"), "debt": ("error", "view", "signup"), "shares": ("signup",)}


def _fact_probes(spark, sf):
    f = inputs.facts(spark, sf)
    span = f.groupBy("cik").agg(F.min("filed").alias("a"), F.max("filed").alias("b"))
    return span.select("cik", F.explode(F.expr("sequence(a - 3, b, interval 10 days)")).alias("cutoff"))


def _facts_long(spark, sf):
    # Even k plays USD, odd k shares; issuers divisible by seven report in neither and use the first unit.
    unit = F.when(F.col("cik") % 7 == 0, 3).when(F.col("k") % 2 == 0, 0).otherwise(1)
    return lookup.facts_as_of(_fact_probes(spark, sf), inputs.facts(spark, sf), _FIELDS, unit)


_FACT_SQL = FACTS + """,
fld(field, tag, tag_rank) AS (VALUES ('cash', 'purchase', 0), ('cash', 'click', 1), ('debt', 'error', 0),
  ('debt', 'view', 1), ('debt', 'signup', 2), ('shares', 'signup', 0)),
probes AS (SELECT cik, CAST(unnest(generate_series(CAST(a AS TIMESTAMP) - INTERVAL 3 DAY, CAST(b AS TIMESTAMP),
    INTERVAL 10 DAY)) AS DATE) AS cutoff FROM (SELECT cik, min(filed) AS a, max(filed) AS b FROM facts GROUP BY 1)),
u AS (SELECT *, CASE WHEN cik % 7 = 0 THEN 3 WHEN k % 2 = 0 THEN 0 ELSE 1 END AS ur FROM facts),
best AS (SELECT * FROM u QUALIFY ur = min(ur) OVER (PARTITION BY cik, tag)),
hits AS (SELECT p.cik, p.cutoff, fld.field, b.tag, b.filed, b."end", b.val, row_number() OVER (
    PARTITION BY p.cik, p.cutoff, fld.field ORDER BY tag_rank, b.filed DESC, b.pos) AS rn
  FROM probes p JOIN best b ON b.cik = p.cik AND b.filed <= p.cutoff AND b."end" <= p.cutoff
  JOIN fld ON fld.tag = b.tag)"""


@register("asof_backward_facts", f"""WITH {_FACT_SQL}
SELECT p.cik, CAST(p.cutoff AS VARCHAR) AS cutoff, f.field, h.tag, CAST(h.filed AS VARCHAR) AS filed,
  CAST(h."end" AS VARCHAR) AS period_end, h.val
FROM probes p CROSS JOIN (SELECT DISTINCT field FROM fld) f
LEFT JOIN hits h ON h.cik = p.cik AND h.cutoff = p.cutoff AND h.field = f.field AND h.rn = 1""")
def asof_backward_facts(spark, sf):
    return _facts_long(spark, sf).select(
        "cik", *s("cutoff"), "field", "fact.tag", F.col("fact.filed").cast("string").alias("filed"),
        F.col("fact.end").cast("string").alias("period_end"), F.col("fact.val").alias("val"))


@register("fundamentals_wide", f"""WITH {_FACT_SQL}
SELECT p.cik, CAST(p.cutoff AS VARCHAR) AS cutoff, max(CASE WHEN field = 'cash' THEN val END) AS cash,
  max(CASE WHEN field = 'debt' THEN val END) AS debt, max(CASE WHEN field = 'shares' THEN val END) AS shares,
  max(CASE WHEN field = 'cash' THEN tag END) AS cash_source_tag,
  CAST(max(CASE WHEN field = 'cash' THEN filed END) AS VARCHAR) AS filing_date
FROM probes p LEFT JOIN hits h ON h.cik = p.cik AND h.cutoff = p.cutoff AND h.rn = 1 GROUP BY p.cik, p.cutoff""")
def fundamentals_wide(spark, sf):
    long = _facts_long(spark, sf)

    def pick(field, part):
        return F.max(F.when(F.col("field") == field, F.col(f"fact.{part}")))

    return long.groupBy("cik", F.col("cutoff").cast("string").alias("cutoff")).agg(
        *[pick(f, "val").alias(f) for f in _FIELDS],
        pick("cash", "tag").alias("cash_source_tag"), pick("cash", "filed").cast("string").alias("filing_date"))


_MAP = """mapping AS (SELECT 'Brand#' || (n_nationkey + 1) AS current_ticker,
    DATE '1996-01-01' + CAST(80 * n_nationkey AS INTEGER) AS before_date,
    'Brand#' || ((n_nationkey + 7) % 25 + 1) AS use_ticker, n_nationkey * 2 AS pos FROM nation
  UNION ALL SELECT 'Brand#' || (n_nationkey + 1), DATE '1999-01-01' + CAST(20 * n_nationkey AS INTEGER),
    CASE WHEN n_nationkey % 3 = 0 THEN 'OLD' || n_nationkey ELSE 'Brand#' || ((n_nationkey + 3) % 25 + 1) END,
    n_nationkey * 2 - 1 FROM nation),
pairs AS (SELECT DISTINCT upper(ticker) AS ticker, announcement_date FROM evts),
cand0 AS (SELECT p.ticker, p.announcement_date, upper(m.use_ticker) AS candidate, m.pos
    FROM pairs p JOIN mapping m ON upper(m.current_ticker) = p.ticker AND p.announcement_date < m.before_date
  UNION ALL SELECT ticker, announcement_date, ticker, 2147483647 FROM pairs),
cand1 AS (SELECT ticker, announcement_date, candidate, min(pos) AS pos FROM cand0 GROUP BY 1, 2, 3),
cand AS (SELECT *, row_number() OVER (PARTITION BY ticker, announcement_date ORDER BY pos) AS rank FROM cand1)"""


def _mapping(spark, sf):
    n = inputs.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    brand = lambda e: F.concat(F.lit("Brand#"), e.cast("string"))
    second = F.when(k % 3 == 0, F.concat(F.lit("OLD"), k.cast("string"))).otherwise(brand((k + 3) % 25 + 1))
    day = lambda base, step: F.date_add(F.lit(base).cast("date"), (k * step).cast("int"))
    rows = F.array(
        F.struct(day("1996-01-01", 80).alias("before_date"), brand((k + 7) % 25 + 1).alias("use_ticker"),
                 (k * 2).cast("long").alias("pos")),
        F.struct(day("1999-01-01", 20).alias("before_date"), second.alias("use_ticker"),
                 (k * 2 - 1).cast("long").alias("pos")),
    )
    return n.select(brand(k + 1).alias("current_ticker"), F.explode(rows).alias("r")).select("current_ticker", "r.*")


@register("ticker_mapping", f"""WITH {EVTS}, {_MAP} SELECT ticker, CAST(announcement_date AS VARCHAR) AS announcement_date,
  candidate, rank FROM cand""")
def ticker_mapping(spark, sf):
    c = lookup.ticker_candidates(inputs.catalysts(spark, sf), _mapping(spark, sf))
    return c.select("ticker", *s("announcement_date"), "candidate", "rank")


_COVER = f"{BARS}, {EVTS}, {_MAP}" + """,
span AS (SELECT upper(ticker) AS candidate, min(date) AS a, max(date) AS b, count(*) AS n FROM bars
  WHERE ticker <> 'Brand#13' OR date < DATE '1998-06-01' GROUP BY 1),
pick AS (SELECT c.ticker, c.announcement_date, s.candidate, s.n, row_number() OVER (
    PARTITION BY c.ticker, c.announcement_date ORDER BY rank) AS rn FROM cand c JOIN span s USING (candidate)
  WHERE s.a <= c.announcement_date + 7 AND s.b >= c.announcement_date - 7),
src AS (SELECT p.ticker, p.announcement_date, coalesce(k.candidate, p.ticker) AS ticker_used, coalesce(k.n, 0) AS n_bars
  FROM pairs p LEFT JOIN (SELECT * FROM pick WHERE rn = 1) k USING (ticker, announcement_date))"""


def _truncated_bars(spark, sf):
    """Bars with one issuer's history ending early, as for a delisting."""
    keep = (F.col("ticker") != "Brand#13") | (F.col("date") < F.lit("1998-06-01").cast("date"))
    return inputs.bars(spark, sf).filter(keep).withColumn("ticker", F.upper("ticker"))


def _price_source(spark, sf):
    c = lookup.ticker_candidates(inputs.catalysts(spark, sf), _mapping(spark, sf))
    return lookup.covering_candidate(c, _truncated_bars(spark, sf))


@register("price_source", f"""WITH {_COVER} SELECT ticker, CAST(announcement_date AS VARCHAR) AS announcement_date,
  ticker_used, n_bars FROM src""")
def price_source(spark, sf):
    return _price_source(spark, sf).select("ticker", *s("announcement_date"), "ticker_used", "n_bars")


@register("price_coverage_audit", f"""WITH {_COVER}
SELECT e.catalyst_id, src.ticker, ticker_used, n_bars, n_bars > 0 AS has_price_data,
  e.clinical_success IS NOT NULL AS has_event_study, src.ticker IN ('BRAND#13', 'BRAND#4') AS known_delisted,
  CASE WHEN n_bars = 0 AND src.ticker IN ('BRAND#13', 'BRAND#4') THEN 'delisted_needs_polygon'
    WHEN n_bars = 0 THEN 'no_price_data' END AS blocker
FROM evts e JOIN src ON src.ticker = upper(e.ticker) AND src.announcement_date = e.announcement_date""")
def price_coverage_audit(spark, sf):
    ev = inputs.catalysts(spark, sf).select(
        "catalyst_id", F.upper("ticker").alias("ticker"), "announcement_date", "clinical_success")
    joined = ev.join(_price_source(spark, sf), ["ticker", "announcement_date"])
    delisted = F.col("ticker").isin("BRAND#13", "BRAND#4")
    none = F.col("n_bars") == 0
    return joined.select(
        "catalyst_id", "ticker", "ticker_used", "n_bars", (~none).alias("has_price_data"),
        F.col("clinical_success").isNotNull().alias("has_event_study"), delisted.alias("known_delisted"),
        F.when(none & delisted, "delisted_needs_polygon").when(none, "no_price_data").alias("blocker"))


@register("provider_fallback", """WITH b AS (SELECT l_partkey AS ticker, CASE l_linenumber WHEN 1 THEN 'local_csv'
    WHEN 2 THEN 'stooq' WHEN 3 THEN 'eodhd' WHEN 4 THEN 'polygon' ELSE 'crsp' END AS provider FROM lineitem),
rk AS (SELECT ticker, provider, CASE provider WHEN 'local_csv' THEN 2 WHEN 'stooq' THEN 3 WHEN 'eodhd' THEN 4
  WHEN 'polygon' THEN 5 END AS rank FROM b WHERE provider <> 'crsp')
SELECT ticker, provider FROM (SELECT DISTINCT ticker, provider, rank, min(rank) OVER (PARTITION BY ticker) AS m FROM rk)
WHERE rank = m""")
def provider_fallback(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    names = F.create_map(*[F.lit(x) for kv in ((1, "local_csv"), (2, "stooq"), (3, "eodhd"), (4, "polygon")) for x in kv])
    bars = li.select(F.col("l_partkey").alias("ticker"),
                     F.coalesce(names[F.col("l_linenumber")], F.lit("crsp")).alias("provider"))
    return lookup.provider_choice(bars, "yfinance")


@register("cache_coverage", f"""WITH b AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_linestatus AS prov,
    avg(l_extendedprice) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT ticker, DATE '1995-01-01' + CAST(substr(ticker, 7) AS INTEGER) AS s, DATE '2000-06-30' AS e FROM b),
c AS (SELECT q.*, coalesce((SELECT min(date) FROM b WHERE b.ticker = q.ticker AND prov = 'F') <= q.s, false) AS cov FROM q)
SELECT b.ticker, cov AS covered, count(*) AS n_bars, CAST(min(date) AS VARCHAR) AS first_date,
  CAST(max(date) AS VARCHAR) AS last_date, {r('avg(px)', 5)} AS mean_close
FROM b JOIN c ON c.ticker = b.ticker AND CASE WHEN cov THEN prov = 'F' AND date <= e
  ELSE prov = 'O' AND date BETWEEN s AND e END GROUP BY 1, 2""")
def cache_coverage(spark, sf):
    b = inputs.bars(spark, sf, by_provider=True)
    brand_no = F.substring("ticker", 7, 3).cast("int")
    req = b.select("ticker").distinct().select(
        "ticker", F.date_add(F.lit("1995-01-01").cast("date"), brand_no).alias("start"),
        F.lit("2000-06-30").cast("date").alias("end"))
    out = lookup.cached_or_fetched(b.filter("provider = 'F'"), b.filter("provider = 'O'"), req)
    return out.groupBy("ticker", "covered").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"), rnd(F.avg("adj_close"), 5).alias("mean_close"))


@register("coverage_requirements", f"""WITH {EVTS} SELECT ticker, CAST(min(announcement_date) - 400 AS VARCHAR)
  AS price_start_required, CAST(max(announcement_date) + 30 AS VARCHAR) AS price_end_required, count(*) AS n_events
FROM evts GROUP BY 1""")
def coverage_requirements(spark, sf):
    return lookup.required_ranges(inputs.catalysts(spark, sf)).select(
        "ticker", *s("price_start_required", "price_end_required"), "n_events")


@register("required_end_per_candidate", f"""WITH {EVTS}, {_MAP} SELECT candidate,
  CAST(max(announcement_date) + 30 AS VARCHAR) AS required_end FROM cand GROUP BY 1""")
def required_end_per_candidate(spark, sf):
    c = lookup.ticker_candidates(inputs.catalysts(spark, sf), _mapping(spark, sf))
    return c.groupBy("candidate").agg(
        F.max(F.date_add("announcement_date", lookup.LOOKAHEAD_DAYS)).cast("string").alias("required_end"))


@register("legacy_event_study", f"""WITH {ALIGNED}, {EVTS}, k AS (SELECT DISTINCT ticker, announcement_date AS d FROM evts),
est AS (SELECT k.ticker, k.d, regr_slope(a.ret, a.spy) AS b, regr_intercept(a.ret, a.spy) AS al, count(*) AS n,
    any_value(a.len) AS len FROM k JOIN rs a ON a.ticker = k.ticker AND a.date < k.d - 30 GROUP BY 1, 2),
near AS (SELECT k.ticker, k.d, a.idx, row_number() OVER (PARTITION BY k.ticker, k.d
    ORDER BY abs(a.date - k.d), a.date DESC) AS rn FROM k JOIN rs a ON a.ticker = k.ticker
    AND a.date BETWEEN k.d - 60 AND k.d + 60),
ok AS (SELECT n.ticker, n.d, n.idx, e.al, e.b FROM near n JOIN est e ON e.ticker = n.ticker AND e.d = n.d
  WHERE rn = 1 AND e.n >= 30 AND e.len >= 60 AND n.idx >= 1 AND n.idx < e.len - 1),
car AS (SELECT ok.ticker, ok.d, sum(a.ret - (ok.al + ok.b * a.spy)) AS car, any_value(ok.al) AS al, any_value(ok.b) AS b
  FROM ok JOIN rs a ON a.ticker = ok.ticker AND a.idx BETWEEN ok.idx - 1 AND ok.idx + 1 GROUP BY 1, 2)
SELECT catalyst_id, {r('car')} AS car, {r('al')} AS alpha, {r('b')} AS beta FROM evts JOIN car
  ON car.ticker = evts.ticker AND car.d = evts.announcement_date""".replace(
    "FROM evts) ,", "FROM evts),").replace("est AS", """rs AS (SELECT ticker, date, ret, spy,
    row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS len
  FROM rets JOIN spy USING (date)),
est AS""", 1))
def legacy_event_study(spark, sf):
    bars = inputs.bars(spark, sf)
    spy = series.benchmark_returns(inputs.benchmarks(spark, sf)).filter("spy is not null").select("date", "spy")
    aligned = series.simple_returns(bars).join(F.broadcast(spy), "date")
    ev = inputs.catalysts(spark, sf).select("catalyst_id", "ticker", "announcement_date")
    return eventstudy.legacy_study(ev, aligned).select(
        "catalyst_id", *[rnd(c).alias(c) for c in ("car", "alpha", "beta")])


@register("missing_price_requirements", f"""WITH {_MATCHED} SELECT e.catalyst_id, e.ticker,
  CAST(e.announcement_date - 400 AS VARCHAR) AS price_start_required,
  CAST(e.announcement_date + 30 AS VARCHAR) AS price_end_required
FROM evts e JOIN guarded g USING (ticker, announcement_date) WHERE g.price_status <> 'ok'""")
def missing_price_requirements(spark, sf):
    bars, al = _aligned(spark, sf)
    m = eventstudy.match_events(_study_events(spark, sf), eventstudy.session_measures(al), bars)
    return m.filter("price_status <> 'ok'").select(
        "catalyst_id", "ticker",
        F.date_sub("announcement_date", lookup.LOOKBACK_DAYS).cast("string").alias("price_start_required"),
        F.date_add("announcement_date", lookup.LOOKAHEAD_DAYS).cast("string").alias("price_end_required"))
