"""Queries: registry upserts, overrides, migration, curation, candidate selection and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.functions.rounding import rnd
from eventide.operators import audits, cutoffs, features, fuzzy, registry
from eventide.plans import inputs
from eventide.plans.inputs import DESIGNS, PHRASES
from eventide.plans.oracle_base import CUTS, EVTS, TRIALS, r
from eventide.session import spread

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def _orders(spark, sf):
    return inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("prio"))


_O = """o AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price,
    CAST(o_orderdate AS DATE) AS d, o_orderpriority AS prio FROM orders)"""

_UP = _O + """,
old AS (SELECT k, price AS v, status AS s FROM o WHERE status <> 'P'),
new AS (SELECT l_orderkey AS k, CASE WHEN max(l_quantity) < 45 THEN max(l_extendedprice) END AS v,
    CASE WHEN count(*) > 3 THEN max(l_returnflag) END AS s FROM lineitem GROUP BY 1)"""


def _upsert_sides(spark, sf):
    """Stored: settled orders. Arriving: one row per order with line items, some values missing."""
    old = _orders(spark, sf).filter("status <> 'P'").select("k", F.col("price").alias("v"), F.col("status").alias("s"))
    new = inputs.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("px"), F.count(F.lit(1)).alias("n"), F.max("l_returnflag").alias("rf"))
    return old, new.select("k", F.when(F.col("q") < 45, F.col("px")).alias("v"), F.when(F.col("n") > 3, F.col("rf")).alias("s"))


@register("upsert", f"""WITH {_UP} SELECT coalesce(old.k, new.k) AS k, coalesce(new.v, old.v) AS v,
  CASE WHEN new.k IS NOT NULL THEN new.s ELSE old.s END AS s FROM old FULL JOIN new ON old.k = new.k""")
def upsert(spark, sf):
    return registry.upsert(*_upsert_sides(spark, sf), ["k"], keep_old_if_null=["v"])


@register("replace_rows", f"""WITH {_UP} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)""")
def replace_rows(spark, sf):
    return registry.replace_rows(*_upsert_sides(spark, sf), ["k"])


_BARS_DUP = """dup AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_linestatus AS provider, l_extendedprice AS px,
    l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _raw_bars(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    p = inputs.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "ticker", F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("provider"),
        F.col("l_extendedprice").alias("px"), "l_orderkey", "l_linenumber")


@register("dedupe_first", f"""WITH {_BARS_DUP} SELECT ticker, CAST(date AS VARCHAR) AS date, px FROM (SELECT *, row_number() OVER (
  PARTITION BY ticker, date ORDER BY l_orderkey, l_linenumber, px) AS rn FROM dup) WHERE rn = 1""")
def dedupe_first(spark, sf):
    d = registry.dedupe_first(_raw_bars(spark, sf), ["ticker", "date"], ["l_orderkey", "l_linenumber", "px"])
    return d.select("ticker", F.col("date").cast("string"), "px")


@register("insert_ignore_bars", f"""WITH {_BARS_DUP}, f AS (SELECT ticker, date, provider, px, row_number() OVER (
    PARTITION BY ticker, date ORDER BY provider DESC, l_orderkey, l_linenumber, px) AS rn,
    max(CASE WHEN provider = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, date) AS has_o FROM dup)
SELECT ticker, CAST(date AS VARCHAR) AS date, provider, px FROM f WHERE rn = 1""")
def insert_ignore_bars(spark, sf):
    """Stored bars (one provider) win; the other provider only fills the gaps."""
    raw = _raw_bars(spark, sf)
    order = ["l_orderkey", "l_linenumber", "px"]
    old = registry.dedupe_first(raw.filter("provider = 'O'"), ["ticker", "date"], order).select("ticker", "date", "provider", "px")
    new = raw.filter("provider = 'F'")
    out = registry.insert_ignore(old, new, ["ticker", "date"], order)
    return out.select("ticker", F.col("date").cast("string"), "provider", "px")


@register("latest_snapshot", """SELECT user_id AS nct_id, arg_max(props, (ts, props)) AS payload,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS observed_at, count(*) AS n_snapshots FROM events GROUP BY 1""")
def latest_snapshot(spark, sf):
    e = inputs.table(spark, sf, "events").select(F.col("user_id").alias("nct_id"), F.col("ts").alias("observed_at"),
                                                 F.col("props").alias("payload"))
    out = registry.latest_snapshot(e, "nct_id", "observed_at", "payload")
    return out.withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"))


_INFER = _O + """,
x AS (SELECT k, CASE WHEN k % 4 <> 0 THEN d END AS ann, CASE WHEN k % 6 = 1 OR k % 8 = 0 THEN d + 30 END AS res,
    CASE WHEN k % 3 = 0 THEN d + 20 END AS outc, CASE WHEN k % 5 <> 0 THEN d - 400 END AS t0,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 7 = 2 THEN 'INFERRED_T0_PLUS_18MO' WHEN k % 7 <> 3 THEN 'PRESS' END AS src FROM o),
y AS (SELECT *, coalesce(ann, res, outc, t0 + 540) AS d1, CASE WHEN ann IS NOT NULL THEN src WHEN res IS NOT NULL
    THEN 'INFERRED_CTGOV_RESULTS' WHEN outc IS NOT NULL THEN 'INFERRED_OUTCOME_DATE' WHEN t0 IS NOT NULL
    THEN 'INFERRED_T0_PLUS_18MO' END AS s1 FROM x)"""


@register("date_backfill", f"""WITH {_INFER} SELECT k, CAST(CASE WHEN s1 = 'INFERRED_T0_PLUS_18MO' AND res IS NOT NULL THEN res ELSE d1 END
  AS VARCHAR) AS announcement_date, CASE WHEN s1 = 'INFERRED_T0_PLUS_18MO' AND res IS NOT NULL THEN 'INFERRED_CTGOV_RESULTS'
  WHEN d1 IS NOT NULL AND s1 IS NULL THEN 'LEGACY_UNTAGGED' ELSE s1 END AS announcement_source FROM y""")
def date_backfill(spark, sf):
    k, d = F.col("k"), F.col("d")
    src = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 7 == 2, "INFERRED_T0_PLUS_18MO").when(k % 7 != 3, "PRESS")
    x = _orders(spark, sf).select(
        "k", F.when(k % 4 != 0, d).alias("announcement_date"),
        F.when((k % 6 == 1) | (k % 8 == 0), F.date_add(d, 30)).alias("results_posted"),
        F.when(k % 3 == 0, F.date_add(d, 20)).alias("outcome_date"), F.when(k % 5 != 0, F.date_sub(d, 400)).alias("t0_date"),
        src.alias("announcement_source"))
    out = registry.infer_dates(x)
    return out.select("k", F.col("announcement_date").cast("string"), "announcement_source")


_OVR = EVTS + """,
ovr AS (SELECT CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS catalyst_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'xx' || o_custkey END AS ticker, CAST(o_orderdate AS DATE) + 7 AS announcement_date,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'AMC' END AS timing FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _overrides(spark, sf):
    k = F.col("o_orderkey")
    urgent = inputs.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return urgent.select(
        F.when(k % 50 == 1, k + 1000000000).otherwise(k).alias("catalyst_id"),
        F.when(k % 4 != 0, F.concat(F.lit("xx"), F.col("o_custkey").cast("string"))).alias("ticker"),
        F.date_add(F.to_date("o_orderdate"), 7).alias("announcement_date"),
        F.when(k % 3 != 0, "AMC").alias("announcement_timing"), F.lit(None).cast("string").alias("announcement_source"))


@register("overrides_apply", f"""WITH {_OVR}, m AS (SELECT e.catalyst_id, o.catalyst_id IS NOT NULL AS hit,
    coalesce(o.announcement_date, e.announcement_date) AS d,
    CASE WHEN o.catalyst_id IS NOT NULL THEN coalesce(o.timing, 'UNKNOWN') ELSE e.timing END AS timing,
    CASE WHEN o.ticker IS NOT NULL THEN upper(o.ticker) ELSE e.ticker END AS ticker
  FROM evts e LEFT JOIN ovr o USING (catalyst_id))
SELECT catalyst_id, ticker, timing, CAST(d AS VARCHAR) AS announcement_date,
  CASE WHEN hit THEN 'PRESS_RELEASE' END AS announcement_source,
  CAST(CASE WHEN timing = 'AMC' THEN d ELSE d - 1 END AS VARCHAR) AS trading_cutoff_date,
  CASE WHEN hit THEN 'HIGH' WHEN timing = 'AMC' THEN 'MEDIUM' WHEN timing = 'BMO' THEN 'HIGH' ELSE 'LOW' END AS execution_confidence FROM m""")
def overrides_apply(spark, sf):
    out = registry.apply_overrides(inputs.catalysts(spark, sf), _overrides(spark, sf))
    return out.select("catalyst_id", "ticker", "timing", F.col("announcement_date").cast("string"), "announcement_source",
                      F.col("trading_cutoff_date").cast("string"), "execution_confidence")


@register("override_counts", f"""WITH {_OVR} SELECT count(e.catalyst_id) AS updated, count(*) FILTER (WHERE e.catalyst_id IS NOT NULL
  AND o.ticker IS NOT NULL) AS tickers, count(*) FILTER (WHERE e.catalyst_id IS NULL) AS missing
FROM ovr o LEFT JOIN evts e USING (catalyst_id)""")
def override_counts(spark, sf):
    return registry.override_counts(inputs.catalysts(spark, sf), _overrides(spark, sf))


@register("delist_sync", f"""WITH {EVTS}, meta AS (SELECT 'brand#' || (n_nationkey + 1) AS t, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS del,
    CASE WHEN n_nationkey % 2 = 0 THEN DATE '2000-01-01' + CAST(n_nationkey AS INTEGER) END AS dd,
    CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS succ FROM nation WHERE n_regionkey IN (0, 2))
SELECT catalyst_id, CASE WHEN t IS NOT NULL THEN CAST(coalesce(del, 0) AS DOUBLE) END AS delisted, CAST(dd AS VARCHAR) AS delist_date,
  succ AS successor_ticker, CASE WHEN t IS NOT NULL THEN 'delist_map' ELSE 'companies_table' END AS map_source
FROM evts LEFT JOIN meta ON upper(t) = upper(ticker)""")
def delist_sync(spark, sf):
    k = F.col("n_nationkey")
    meta = inputs.table(spark, sf, "nation").filter("n_regionkey in (0, 2)").select(
        F.concat(F.lit("brand#"), (k + 1).cast("string")).alias("ticker"), F.when(k % 2 == 0, 1).alias("delisted"),
        F.when(k % 2 == 0, F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int"))).alias("delist_date"),
        F.when(k % 4 == 0, F.col("n_name")).alias("successor_ticker"))
    hist = inputs.catalysts(spark, sf).select(
        "catalyst_id", "ticker", F.lit(None).cast("int").alias("delisted"), F.lit(None).cast("date").alias("delist_date"),
        F.lit(None).cast("string").alias("successor_ticker"), F.lit("companies_table").alias("map_source"))
    return registry.sync_delist(hist, meta).select(
        "catalyst_id", F.col("delisted").cast("double"), F.col("delist_date").cast("string"), "successor_ticker", "map_source")


_MIG = _O + """,
fin AS (SELECT l_orderkey AS pid, l_returnflag AS t, CAST(l_shipdate AS DATE) AS d, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY CAST(l_shipdate AS DATE), l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem WHERE l_returnflag <> 'N'),
n AS (SELECT l_orderkey AS pid, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
mig AS (SELECT o.*, fin.t, coalesce(fin.d, CASE WHEN k % 3 = 0 THEN o.d + 5 END, o.d) AS ann, coalesce(n.n, 0) AS ns, fin.d IS NOT NULL AS linked
  FROM o LEFT JOIN fin ON fin.pid = k AND rn = 1 LEFT JOIN n ON n.pid = k WHERE prio <> '5-LOW')"""


@register("registry_migrate", f"""WITH {_MIG} SELECT 'CAT-' || k AS catalyst_id, coalesce(t, 'PHASE2_READOUT') AS catalyst_type,
  CAST(ann AS VARCHAR) AS announcement_date, CAST(ann - 1 AS VARCHAR) AS trading_cutoff_date,
  CASE WHEN status = 'P' AND k % 2 = 0 THEN 'UNKNOWN' WHEN status = 'F' THEN 'SUCCESS' WHEN k % 5 = 0 THEN 'SAFETY_FAILURE'
    WHEN k % 5 = 1 THEN 'EFFICACY_FAILURE' ELSE 'MIXED' END AS outcome_category,
  CASE WHEN ns > 0 THEN 1 ELSE 0 END AS preclinical_evidence_found, linked AS linked_event FROM mig""")
def registry_migrate(spark, sf):
    k = F.col("k")
    o = _orders(spark, sf)
    li = inputs.table(spark, sf, "lineitem")
    n = li.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_studies"))
    progs = o.join(n, "k", "left").select(
        k.alias("program_id"), F.when(k % 3 == 0, F.date_add("d", 5)).alias("outcome_date"), F.col("d").alias("t0_date"),
        (F.col("status") == "F").cast("int").alias("clinical_success"), (k % 5 == 1).cast("int").alias("technical_failure"),
        (k % 5 == 0).cast("int").alias("safety_failure"),
        ((F.col("status") == "P") & (k % 2 == 0)).cast("int").alias("outcome_unknown"), "n_studies")
    fin = li.filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("program_id"), F.col("l_returnflag").alias("event_type"),
        F.to_date("l_shipdate").alias("event_date"),
        F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("pos"))
    done = o.filter("prio = '5-LOW'").select(k.alias("program_id"))
    return registry.migrate_programs(progs, done, fin).select(
        "catalyst_id", "catalyst_type", F.col("announcement_date").cast("string"), F.col("trading_cutoff_date").cast("string"),
        "outcome_category", "preclinical_evidence_found", "linked_event")


@register("first_financial_event", f"""WITH {_MIG} SELECT pid AS program_id, CAST(d AS VARCHAR) AS event_date, t AS event_type FROM fin WHERE rn = 1""")
def first_financial_event(spark, sf):
    li = inputs.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").withColumn("d", F.to_date("l_shipdate"))
    f = features.first_or_none(li, ["l_orderkey"], ["d", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], ["d", "l_returnflag"])
    return f.select(F.col("l_orderkey").alias("program_id"), F.col("d").cast("string").alias("event_date"),
                    F.col("l_returnflag").alias("event_type"))


@register("programs_without_events", """SELECT o_orderkey AS program_id FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def programs_without_events(spark, sf):
    o = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("program_id"))
    li = inputs.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("program_id"))
    return o.join(li, "program_id", "left_anti")


_CATS = """CASE WHEN status = 'F' AND k % 3 <> 0 AND k % 5 <> 0 THEN 'SUCCESS' WHEN k % 5 = 0 THEN 'SAFETY_FAILURE'
  WHEN k % 3 = 0 OR status <> 'F' THEN 'EFFICACY_FAILURE' ELSE 'MIXED' END"""


@register("expand_category", f"WITH {_O} SELECT k, {_CATS} AS outcome_category FROM o")
def expand_category(spark, sf):
    k = F.col("k")
    cat = registry.expand_category((F.col("status") == "F").cast("int"), (k % 3 == 0).cast("int"), (k % 5 == 0).cast("int"))
    return _orders(spark, sf).select("k", cat.alias("outcome_category"))


_STATUS = ("COMPLETED", "TERMINATED", "WITHDRAWN", "RECRUITING", "UNKNOWN")
_WHY = ("Safety concerns", "Lack of efficacy", "Business decision", "Other", None, "toxicity and futility")

_LAB = _O + """,
l AS (SELECT k, CASE k % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'TERMINATED' WHEN 2 THEN 'WITHDRAWN' WHEN 3 THEN 'RECRUITING'
    ELSE 'UNKNOWN' END AS st, lower(coalesce(CASE k % 6 WHEN 0 THEN 'Safety concerns' WHEN 1 THEN 'Lack of efficacy' WHEN 2 THEN
    'Business decision' WHEN 3 THEN 'Other' WHEN 5 THEN 'toxicity and futility' END, '')) AS w,
    CASE status WHEN 'F' THEN true WHEN 'O' THEN false END AS met FROM o),
z AS (SELECT *, st IN ('COMPLETED', 'RECRUITING') AS ran, st = 'TERMINATED' AS term, regexp_matches(w, 'safety|toxic|adverse|death') AS sw,
    regexp_matches(w, 'efficacy|futility|lack of|failed') AS ew, regexp_matches(w, 'business|strategic|sponsor|commercial') AS cw FROM l)"""


def _label_input(spark, sf):
    k = F.col("k")
    pick = lambda arr, m: F.element_at(F.array(*[F.lit(v).cast("string") for v in arr]), (k % m + 1).cast("int"))
    met = F.when(F.col("status") == "F", True).when(F.col("status") == "O", False)
    return _orders(spark, sf).select("k", pick(_STATUS, 5).alias("st"), pick(_WHY, 6).alias("why"), met.alias("met"))


@register("outcome_labels", f"""WITH {_LAB} SELECT k, CAST(CASE WHEN ran AND met THEN 1 WHEN ran AND met = false THEN 0
    WHEN term OR st = 'WITHDRAWN' THEN 0 END AS DOUBLE) AS clinical_success, CAST(CAST(met AS INT) AS DOUBLE) AS met_primary_endpoint,
  CASE WHEN (ran AND met = false) OR (term AND NOT sw AND ew) THEN 1 ELSE 0 END AS technical_failure,
  CASE WHEN term AND sw THEN 1 ELSE 0 END AS safety_failure,
  CASE WHEN term AND NOT sw AND NOT ew AND cw THEN 1 ELSE 0 END AS commercial_discontinuation,
  CASE WHEN (ran AND met IS NULL) OR st = 'WITHDRAWN' OR (term AND NOT sw AND NOT ew AND NOT cw) THEN 1 ELSE 0 END AS outcome_unknown FROM z""")
def outcome_labels(spark, sf):
    lab = registry.outcome_labels(F.col("st"), F.col("why"), F.col("met"))
    out = _label_input(spark, sf).select("k", *[c.alias(n) for n, c in lab.items()])
    return out.withColumns({c: F.col(c).cast("double") for c in ("clinical_success", "met_primary_endpoint")})


_CAND = """cand AS (SELECT o_orderkey AS candidate_id, 'Brand#' || (c_nationkey + 1) AS ticker, CAST(o_orderdate AS DATE) + 5110 AS d,
    CASE o_orderkey % 4 WHEN 0 THEN 'Phase 2' WHEN 1 THEN 'phase3' WHEN 2 THEN 'Phase 1' END AS stage,
    CASE o_orderkey % 3 WHEN 0 THEN 'Top-line data' WHEN 1 THEN 'Update' ELSE 'did not meet endpoint' END AS notes
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _candidates(spark, sf):
    o = inputs.table(spark, sf, "orders")
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("candidate_id"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("ticker"),
        F.date_add(F.to_date("o_orderdate"), 5110).alias("announcement_date"),
        F.when(k % 4 == 0, "Phase 2").when(k % 4 == 1, "phase3").when(k % 4 == 2, "Phase 1").alias("stage"),
        F.when(k % 3 == 0, "Top-line data").when(k % 3 == 1, "Update").otherwise("did not meet endpoint").alias("notes"))


@register("candidate_filter", f"""WITH {_CAND} SELECT candidate_id, ticker FROM cand WHERE upper(ticker) NOT IN ('BRAND#1', 'BRAND#2')
  AND year(d) BETWEEN 2010 AND 2014 AND regexp_matches(coalesce(stage, ''), 'Phase\\s*[23]', 'i')
  AND regexp_matches(notes, 'top.?line|primary endpoint|did not meet|met primary|phase [23]|readout|trial data', 'i')""")
def candidate_filter(spark, sf):
    return registry.candidate_filter(_candidates(spark, sf), ("BRAND#1", "BRAND#2"), (2010, 2014)).select("candidate_id", "ticker")


@register("phase_predicates", f"""WITH {TRIALS}, {_CAND} SELECT 'phase_has_2' AS rule, count(*) AS n FROM trials WHERE contains(upper(phase), '2')
UNION ALL SELECT 'stage_2_or_3', count(*) FROM cand WHERE contains(lower(stage), 'phase 2') OR contains(lower(stage), 'phase 3')
UNION ALL SELECT 't0_window', count(*) FROM cand WHERE year(d) BETWEEN 2010 AND 2012
UNION ALL SELECT 'split_' || CASE WHEN year(d) <= 2016 - 3 THEN 'train' WHEN year(d) <= 2018 - 3 THEN 'validation' ELSE 'test' END, count(*)
  FROM cand GROUP BY 1""")
def phase_predicates(spark, sf):
    t, c = inputs.trials(spark, sf), _candidates(spark, sf)
    year = F.year("announcement_date")
    rules = [
        ("phase_has_2", t.filter(cutoffs.phase_has(F.col("phase"), "2"))),
        ("stage_2_or_3", c.filter(cutoffs.stage_mentions(F.col("stage"), "2", "3"))),
        ("t0_window", c.filter(cutoffs.in_t0_window(F.col("announcement_date"), 2010, 2012))),
    ]
    out = c.groupBy(F.concat(F.lit("split_"), cutoffs.temporal_split(year + 3)).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in rules:
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n"))
    return out


_SEARCH = _O + """,
c AS (SELECT k AS pid, prio, price, CASE k % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' ELSE 'old' END AS drug,
    CASE k % 3 WHEN 0 THEN 'ECONOMY_x' WHEN 1 THEN 'PROMO' ELSE 'SMALL' END AS hint,
    CASE k % 3 WHEN 0 THEN 'PHASE3' WHEN 1 THEN 'PHASE2' ELSE '' END AS pref FROM o),
s AS (SELECT l_orderkey AS pid, 'NCT' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS nct, p_name AS title, p_type AS cond,
    CASE l_linenumber WHEN 1 THEN 'PHASE1' WHEN 2 THEN 'PHASE2' WHEN 3 THEN 'PHASE3' WHEN 4 THEN 'PHASE2/PHASE3' ELSE 'Phase2' END AS phase,
    CASE WHEN l_quantity > 5 THEN CAST(l_shipdate AS DATE) + 5478 END AS st, CAST(l_shipdate AS DATE) + 5400 AS fp, l_returnflag AS rf,
    l_linestatus AS ls, l_extendedprice AS px FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT c.pid, nct, st, fp, rf, ls, CASE WHEN contains(lower(title), drug) THEN 2 ELSE 0 END
    + CASE WHEN contains(lower(cond), substr(replace(lower(hint), '_', ' '), 1, 4)) OR contains(lower(title), substr(lower(hint), 1, 4)) THEN 1 ELSE 0 END
    + CASE WHEN (contains(pref, '3') AND contains(upper(phase), '3')) OR (contains(pref, '2') AND contains(upper(phase), '2')) THEN 1 ELSE 0 END AS score
  FROM c JOIN s ON s.pid = c.pid WHERE (contains(upper(phase), '2') OR contains(upper(phase), '3'))
    AND (st IS NULL OR year(st) BETWEEN 2010 AND 2020)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, coalesce(st, DATE '2000-01-01'), nct, fp, rf, ls) AS rn FROM j) WHERE rn = 1)"""


def _search(spark, sf):
    k = F.col("k")
    cand = _orders(spark, sf).select(
        k.alias("program_id"), "prio", "price",
        F.when(k % 4 == 0, "small").when(k % 4 == 1, "red").when(k % 4 == 2, "blue").otherwise("old").alias("drug"),
        F.when(k % 3 == 0, "ECONOMY_x").when(k % 3 == 1, "PROMO").otherwise("SMALL").alias("indication_hint"),
        F.when(k % 3 == 0, "PHASE3").when(k % 3 == 1, "PHASE2").otherwise("").alias("prefer_phase"))
    li, p = inputs.table(spark, sf, "lineitem"), inputs.table(spark, sf, "part")
    n = F.col("l_linenumber")
    phase = F.when(n == 1, "PHASE1").when(n == 2, "PHASE2").when(n == 3, "PHASE3").when(n == 4, "PHASE2/PHASE3").otherwise("Phase2")
    ship = F.to_date("l_shipdate")
    studies = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("program_id"),
        F.concat(F.lit("NCT"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")).alias("nct_id"), phase.alias("phase"),
        F.col("p_name").alias("title"), F.array("p_type").alias("conditions"), F.lit(None).cast("array<string>").alias("interventions"),
        F.when(F.col("l_quantity") > 5, F.date_add(ship, 5478)).alias("start_date"), F.date_add(ship, 5400).alias("first_posted"),
        F.when(F.col("l_returnflag") == "A", "COMPLETED").when(F.col("l_returnflag") == "R", "TERMINATED").otherwise("WITHDRAWN")
        .alias("overall_status"),
        F.lit("lack of accrual").alias("why_stopped"), (F.col("l_linestatus") == "F").alias("primary_met"))
    return cand, studies


@register("study_pick", f"WITH {_SEARCH} SELECT pid AS program_id, nct AS nct_id, CAST(score AS INTEGER) AS score FROM best")
def study_pick(spark, sf):
    cand, studies = _search(spark, sf)
    return registry.pick_study(studies.join(cand, "program_id"), "program_id", F.col("prefer_phase")).select(
        "program_id", "nct_id", "score")


_PUBS = """pubs AS (SELECT l_orderkey AS pid, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) + 5300 END AS pd, l_partkey, l_suppkey,
    l_linenumber, l_extendedprice FROM lineitem)"""


def _landed_pubs(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("program_id"), F.when(F.col("l_linenumber") != 7, F.date_add(F.to_date("l_shipdate"), 5300)).alias("publication_date"),
        F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("pos"))


@register("pre_t0_publications", f"""WITH {_O}, {_PUBS} SELECT pid AS program_id, l_partkey, rank FROM (SELECT pid, l_partkey, row_number() OVER (
  PARTITION BY pid ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rank FROM pubs JOIN o ON o.k = pid
  WHERE pd IS NOT NULL AND pd <= d + 5330) WHERE rank <= 5""")
def pre_t0_publications(spark, sf):
    t0 = _orders(spark, sf).select(F.col("k").alias("program_id"), F.date_add("d", 5330).alias("t0_date"))
    return registry.pre_t0_publications(_landed_pubs(spark, sf), t0, 5).select("program_id", "pos.l_partkey", "rank")


@register("cohort_load", f"""WITH {_SEARCH}, {_PUBS}, q AS (SELECT c.pid, nct, score, coalesce(st, fp) AS t0,
    CASE WHEN st IS NOT NULL THEN 'TRIAL_START' WHEN nct IS NOT NULL THEN 'OTHER' END AS def,
    CASE WHEN c.price > 450000 AND nct IS NOT NULL THEN 1 WHEN rf = 'A' AND ls = 'F' THEN 1 WHEN nct IS NOT NULL THEN 0 END AS cs
  FROM c LEFT JOIN best ON best.pid = c.pid WHERE c.prio <> '5-LOW'),
np AS (SELECT q.pid, least(count(*), 8) AS n FROM q JOIN pubs ON pubs.pid = q.pid AND pd <= t0 GROUP BY 1)
SELECT q.pid AS program_id, nct AS nct_id, CAST(t0 AS VARCHAR) AS t0_date, def AS t0_definition, CAST(cs AS DOUBLE) AS clinical_success,
  coalesce(np.n, 0) AS n_publications, CASE WHEN nct IS NULL THEN 'no_study' WHEN year(t0) NOT BETWEEN 2010 AND 2020 THEN 't0_out_of_window'
    ELSE 'loaded' END AS status FROM q LEFT JOIN np USING (pid)""")
def cohort_load(spark, sf):
    cand, studies = _search(spark, sf)
    done = cand.filter("prio = '5-LOW'").select("program_id")
    decisions = cand.filter("price > 450000").select("program_id", F.lit(1).alias("clinical_success"))
    out = registry.cohort_load(cand.drop("prio", "price"), done, studies, _landed_pubs(spark, sf), decisions, None, 8)
    return out.select("program_id", "nct_id", F.col("t0_date").cast("string"), "t0_definition",
                      F.col("clinical_success").cast("double"), "n_publications", "status")


@register("literature_gap", """WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS program_id, '(("' || c_mktsegment || '"[Title/Abstract] OR "alt ' || c_mktsegment || '"[Title/Abstract]) AND ("mice"[Title/Abstract]'
  || ' OR "mouse"[Title/Abstract] OR "xenograft"[Title/Abstract] OR "murine"[Title/Abstract] OR "rat"[Title/Abstract])) AND (1800/01/01[PDAT] : '
  || strftime(o_orderdate, '%Y/%m/%d') || '[PDAT])' AS query FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON n.k = o_orderkey
WHERE coalesce(n.n, 0) < 1""")
def literature_gap(spark, sf):
    counts = inputs.table(spark, sf, "lineitem").filter("l_linestatus = 'F'").groupBy(
        F.col("l_orderkey").alias("program_id")).agg(F.count(F.lit(1)).alias("n_studies"))
    progs = inputs.catalysts(spark, sf).select(F.col("catalyst_id").alias("program_id"), "drug_name", "announcement_date")
    names = F.array_distinct(F.array(F.col("drug_name"), F.concat(F.lit("alt "), F.col("drug_name")), F.col("drug_name")))
    gap = registry.gap_programs(progs, counts, 1)
    return gap.select("program_id", registry.literature_query(names, max_date=F.col("announcement_date")).alias("query"))


@register("abstract_cues", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'mouse|mice') THEN 'mouse' END AS species,
  CASE WHEN contains(lower(text), 'xenograft') THEN 'xenograft' WHEN contains(lower(text), 'transgenic') THEN 'GEMM' END AS disease_model,
  CASE WHEN regexp_matches(lower(text), 'xenograft|mice|mouse|murine|rat') THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS extraction_confidence,
  md5(text) AS sentence_md5 FROM documents""")
def abstract_cues(spark, sf):
    cues = registry.abstract_cues(F.col("text"))
    return spread(inputs.table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", *[cues[c].alias(c) for c in ("species", "disease_model", "extraction_confidence")],
        F.md5(cues["source_sentence"]).alias("sentence_md5"))


_EXT = """st AS (SELECT l_orderkey AS pid, l_partkey AS pmid, min(l_returnflag) AS sp, min(l_linestatus) AS dm FROM lineitem GROUP BY 1, 2),
spec0 AS (SELECT l_orderkey AS pid, CASE WHEN l_quantity > 40 THEN l_partkey + 1000000 ELSE l_partkey END AS pmid,
    max(CASE WHEN l_tax > 0.04 THEN 'PDX' END) AS sp FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
inh AS (SELECT o_orderkey AS pid, o_orderkey - 1 AS parent FROM orders WHERE o_orderstatus = 'P'),
rall AS (SELECT o_orderkey AS pid FROM orders WHERE o_totalprice > 480000),
spec AS (SELECT * FROM spec0 UNION ALL SELECT i.pid, s.pmid, s.sp FROM inh i JOIN spec0 s ON s.pid = i.parent WHERE i.pid NOT IN (SELECT pid FROM spec0)),
rej0 AS (SELECT DISTINCT l_orderkey AS pid, l_partkey AS pmid FROM lineitem WHERE l_linenumber = 7),
rej AS (SELECT * FROM rej0 UNION SELECT i.pid, r.pmid FROM inh i JOIN rej0 r ON r.pid = i.parent),
u AS (SELECT coalesce(st.pid, spec.pid) AS pid, coalesce(st.pmid, spec.pmid) AS pmid, coalesce(spec.sp, st.sp) AS species, st.dm AS disease_model,
    st.pid IS NOT NULL AS old, spec.pid IS NOT NULL AS has FROM st FULL JOIN spec ON st.pid = spec.pid AND st.pmid = spec.pmid)"""


@register("extractions_apply", f"""WITH {_EXT} SELECT u.pid AS program_id, u.pmid, species, disease_model,
  CASE WHEN has THEN 'verified' WHEN r.pid IS NOT NULL OR u.pid IN (SELECT pid FROM rall) THEN 'rejected' ELSE 'pending' END AS verification_status,
  CASE WHEN has AND old THEN 'updated' WHEN has THEN 'added' WHEN r.pid IS NOT NULL OR u.pid IN (SELECT pid FROM rall) THEN 'rejected' ELSE 'kept' END AS action
FROM u LEFT JOIN rej r ON r.pid = u.pid AND r.pmid = u.pmid""")
def extractions_apply(spark, sf):
    return _extractions(spark, sf)


def _extractions(spark, sf):
    li = inputs.table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "program_id", "l_partkey": "pmid"})
    key = ["program_id", "pmid"]
    st = li.groupBy(*key).agg(F.min("l_returnflag").alias("species"), F.min("l_linestatus").alias("disease_model")).withColumn(
        "verification_status", F.lit("pending"))
    pm = F.when(F.col("l_quantity") > 40, F.col("pmid") + 1000000).otherwise(F.col("pmid"))
    spec = li.filter("l_linenumber = 1").withColumn("pmid", pm).groupBy(*key).agg(
        F.max(F.when(F.col("l_tax") > 0.04, "PDX")).alias("species")).withColumns(
        {"disease_model": F.lit(None).cast("string"), "verification_status": F.lit(None).cast("string")})
    progs = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("program_id"), "o_orderstatus", "o_totalprice")
    inherit = progs.filter("o_orderstatus = 'P'").select("program_id").withColumn("inherit_from", F.col("program_id") - 1)
    rej = li.filter("l_linenumber = 7").select(*key).distinct()
    return registry.apply_extractions(
        st, registry.effective_specs(spec, inherit), registry.effective_rejects(rej, inherit), progs.filter("o_totalprice > 480000").select("program_id"))


@register("extraction_summary", f"""WITH {_EXT}, a AS (SELECT u.pid, CASE WHEN has AND old THEN 'updated' WHEN has THEN 'added'
    WHEN r.pid IS NOT NULL OR u.pid IN (SELECT pid FROM rall) THEN 'rejected' ELSE 'kept' END AS action FROM u LEFT JOIN rej r ON r.pid = u.pid AND r.pmid = u.pmid)
SELECT c_mktsegment AS drug_name, action, count(*) AS n, count(DISTINCT pid) AS n_programs FROM a JOIN orders ON o_orderkey = pid
JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def extraction_summary(spark, sf):
    ev = inputs.catalysts(spark, sf).select(F.col("catalyst_id").alias("program_id"), "drug_name")
    return _extractions(spark, sf).join(ev, "program_id").groupBy("drug_name", "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("program_id").alias("n_programs")).orderBy("drug_name", "action")


@register("publication_date_repair", """WITH s AS (SELECT DISTINCT l_orderkey AS program_id, l_partkey AS pmid FROM lineitem WHERE l_linenumber = 7),
d AS (SELECT s.*, CAST(o_orderdate AS DATE) + 30 AS t0, CASE WHEN pmid % 3 = 0 THEN DATE '1998-01-01' + CAST(pmid % 1000 AS INTEGER)
    WHEN pmid % 3 = 1 THEN DATE '1996-06-01' + CAST(pmid % 500 AS INTEGER) END AS pd FROM s JOIN orders ON o_orderkey = program_id)
SELECT program_id, pmid, CAST(pd AS VARCHAR) AS publication_date, CASE WHEN pd IS NULL THEN 'pending' WHEN pd > t0 THEN 'rejected' ELSE 'updated' END
  AS action FROM d""")
def publication_date_repair(spark, sf):
    s = inputs.table(spark, sf, "lineitem").filter("l_linenumber = 7").select(
        F.col("l_orderkey").alias("program_id"), F.col("l_partkey").alias("pmid")).distinct().withColumns(
        {"verification_status": F.lit("verified"), "publication_date": F.lit(None).cast("date")})
    pm = F.col("p_partkey")
    part = inputs.table(spark, sf, "part")
    day = lambda base, m: F.date_add(F.lit(base).cast("date"), (pm % m).cast("int"))
    known = part.filter(pm % 3 == 0).select(pm.alias("pmid"), day("1998-01-01", 1000).alias("publication_date"))
    fetched = part.filter(pm % 3 == 1).select(pm.alias("pmid"), day("1996-06-01", 500).alias("publication_date"))
    t0 = _orders(spark, sf).select(F.col("k").alias("program_id"), F.date_add("d", 30).alias("t0_date"))
    return registry.repair_dates(s, known, fetched, t0).select("program_id", "pmid", F.col("publication_date").cast("string"), "action")


@register("constraint_check", """SELECT 'discount_range' AS rule, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS n_bad FROM lineitem
UNION ALL SELECT 'flag_domain', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'unique_order_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lineitem_has_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def constraint_check(spark, sf):
    li, o = inputs.table(spark, sf, "lineitem"), inputs.table(spark, sf, "orders")
    checks = audits.constraint_counts(li, {
        "discount_range": F.col("l_discount").between(0, 0.05), "flag_domain": F.col("l_returnflag").isin("A", "N")})
    return (
        checks.unionByName(audits.duplicate_keys(li, ["l_orderkey", "l_linenumber"], "unique_order_line"))
        .unionByName(audits.orphan_keys(li, "l_orderkey", o.filter("o_orderstatus <> 'P'"), "o_orderkey", "lineitem_has_order"))
    )


@register("weekday_calendar", """SELECT CAST(d AS VARCHAR) AS d FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate),
  INTERVAL 1 DAY)) AS DATE) AS d FROM orders) WHERE dayofweek(d) BETWEEN 1 AND 5""")
def weekday_calendar(spark, sf):
    span = inputs.table(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("d"))
    return days.filter(F.dayofweek("d").between(2, 6)).select(F.col("d").cast("string"))


@register("partial_dates", """WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%-m') WHEN 2 THEN strftime(o_orderdate, '%Y-%b-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t,
    CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, CAST(CASE k % 4 WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) ELSE d END AS VARCHAR)[1:10] AS parsed FROM x""")
def partial_dates(spark, sf):
    k, d = F.col("k"), F.col("d")
    text = (F.when(k % 4 == 0, F.date_format(d, "yyyy")).when(k % 4 == 1, F.date_format(d, "yyyy-M"))
            .when(k % 4 == 2, F.date_format(d, "yyyy-MMM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd")))
    return _orders(spark, sf).select("k", sc.partial_date(text).cast("string").alias("parsed"))


@register("mixed_dates", """SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders""")
def mixed_dates(spark, sf):
    serial = F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string")
    text = F.when(F.col("k") % 2 == 0, F.date_format("d", "M/d/yyyy")).otherwise(serial)
    return _orders(spark, sf).select("k", sc.mixed_date(text).cast("string").alias("parsed"))


@register("symbol_forms", """SELECT n_nationkey, upper(n_name) || '.US' AS eodhd, CASE WHEN n_nationkey % 5 = 0 THEN upper(n_name) || '.X'
  ELSE upper(n_name) || '.us' END AS stooq, trim(regexp_replace(lower(n_name || ' (B)'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM nation""")
def symbol_forms(spark, sf):
    n = F.col("n_name")
    dotted = F.when(F.col("n_nationkey") % 5 == 0, F.concat(n, F.lit(".x"))).otherwise(n)
    return inputs.table(spark, sf, "nation").select(
        "n_nationkey", sc.vendor_symbol(n, ".US").alias("eodhd"), sc.vendor_symbol(dotted, ".us").alias("stooq"),
        sc.normalize_name(F.concat(n, F.lit(" (B)"))).alias("norm"))


@register("window_labels", """WITH w(label, a, b) AS (VALUES ('[-5,+5]', -5, 5), ('[-1,+1]', -1, 1), ('[0,+20]', 0, 20))
SELECT o_orderkey AS k, a AS start_off, b AS end_off FROM orders JOIN w ON w.label = CASE o_orderkey % 3 WHEN 0 THEN '[-5,+5]' WHEN 1 THEN '[-1,+1]' ELSE '[0,+20]' END""")
def window_labels(spark, sf):
    from eventide.operators.eventstudy import parse_window

    k = F.col("k")
    lo, hi = parse_window(F.when(k % 3 == 0, " [-5,+5]").when(k % 3 == 1, "[-1,+1] ").otherwise("[0,+20]"))
    return _orders(spark, sf).select("k", lo.alias("start_off"), hi.alias("end_off"))


@register("name_sets", """SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS names FROM orders GROUP BY 1""")
def name_sets(spark, sf):
    """Union of two reject lists per customer, first occurrence kept, shown sorted."""
    o = inputs.table(spark, sf, "orders")
    half = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    k = F.col("o_orderkey") % 2
    both = o.groupBy("o_custkey").agg(half(k == 0).alias("a"), half(k == 1).alias("b"))
    return both.select("o_custkey", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("names"))


@register("distinct_pairs", f"WITH {EVTS} SELECT DISTINCT ticker, timing FROM evts")
def distinct_pairs(spark, sf):
    return inputs.catalysts(spark, sf).select("ticker", "timing").distinct()


@register("union_missing_columns", f"""WITH {_O} SELECT k, price, NULL::VARCHAR AS prio FROM o WHERE status = 'F'
UNION ALL SELECT k, NULL, prio FROM o WHERE status <> 'F'""")
def union_missing_columns(spark, sf):
    o = _orders(spark, sf)
    a = o.filter("status = 'F'").select("k", "price")
    return a.unionByName(o.filter("status <> 'F'").select("k", "prio"), allowMissingColumns=True)


def _fuzzy_sides(spark, sf):
    k = F.col("p_partkey")
    base = F.lit("1996-01-01").cast("date")
    part = inputs.table(spark, sf, "part")
    src = F.when(k % 4 == 0, "INFERRED_T0_PLUS_18MO").when(k % 4 == 1, "PRESS").when(k % 4 == 2, "LEGACY_UNTAGGED")
    reg = part.select(k.alias("catalyst_id"), F.col("p_brand").alias("ticker"), F.col("p_name").alias("drug_name"),
                      F.date_add(base, (k % 1500).cast("int")).alias("announcement_date"), src.alias("announcement_source"))
    word = F.split("p_name", " ")
    drug = F.when(k % 3 == 0, F.concat(word[1], F.lit("-"), word[0])).when(k % 3 == 1, F.replace("p_name", F.lit("e"), F.lit("o"))).otherwise(
        F.concat(word[0], F.lit(" kit")))
    ev = part.select(k.alias("event_id"), F.lower("p_brand").alias("ticker"), drug.alias("drug"),
                     F.date_add(base, ((k * 7) % 1500).cast("int")).alias("event_date"))
    return reg, ev


_FUZZY = """reg AS (SELECT p_partkey AS catalyst_id, upper(p_brand) AS tk, p_brand AS ticker, p_name AS name, DATE '1996-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS d,
    CASE p_partkey % 4 WHEN 0 THEN 'INFERRED_T0_PLUS_18MO' WHEN 1 THEN 'PRESS' WHEN 2 THEN 'LEGACY_UNTAGGED' END AS src FROM part),
ext AS (SELECT p_partkey AS event_id, upper(p_brand) AS tk, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    WHEN 1 THEN replace(p_name, 'e', 'o') ELSE split_part(p_name, ' ', 1) || ' kit' END AS other, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1)
    WHEN 1 THEN replace(p_name, 'e', 'o') ELSE split_part(p_name, ' ', 1) || ' kit' END AS drug, DATE '1996-01-01' + CAST((p_partkey * 7) % 1500 AS INTEGER) AS ed FROM part),
sc AS (SELECT n.name, o.other, CASE WHEN contains(name, other) OR contains(other, name) THEN 0.95::DOUBLE
    ELSE 1 - levenshtein(name, other) / CAST(greatest(length(name), length(other)) AS DOUBLE) END AS score
  FROM (SELECT DISTINCT name FROM reg) n, (SELECT DISTINCT other FROM ext) o),
mt AS (SELECT r.catalyst_id, r.ticker, r.d, r.src, r.name, e.event_id, e.ed, e.other, e.drug, sc.score, row_number() OVER (PARTITION BY r.catalyst_id
    ORDER BY sc.score DESC, abs(e.ed - r.d), e.ed, e.event_id) AS rn
  FROM reg r JOIN ext e ON e.tk = r.tk AND abs(e.ed - r.d) <= 365 JOIN sc ON sc.name = r.name AND sc.other = e.other WHERE sc.score >= 0.45),
fm AS (SELECT reg.catalyst_id, reg.ticker, reg.src, m.ed, m.ed - reg.d AS delta, m.score, m.drug, CASE WHEN m.ed IS NULL THEN 'NO_MATCH'
    WHEN abs(m.ed - reg.d) <= 7 THEN 'EXACT' WHEN abs(m.ed - reg.d) <= 30 THEN 'CLOSE' WHEN abs(m.ed - reg.d) <= 90 THEN 'MODERATE_DRIFT'
    ELSE 'LARGE_DRIFT' END AS match_status FROM reg LEFT JOIN (SELECT * FROM mt WHERE rn = 1) m USING (catalyst_id))"""


def _lev(spark, sf):
    return fuzzy.match_events(*_fuzzy_sides(spark, sf), ratio=fuzzy.levenshtein_ratio)


@register("fuzzy_match_edit_distance", f"""WITH {_FUZZY} SELECT catalyst_id, CAST(ed AS VARCHAR) AS matched_date,
  CAST(delta AS DOUBLE) AS date_delta_days, {r('score', 3)} AS drug_score, match_status FROM fm""")
def fuzzy_match_edit_distance(spark, sf):
    return _lev(spark, sf).select("catalyst_id", F.col("matched_date").cast("string"), F.col("date_delta_days").cast("double"),
                                  rnd("drug_score", 3).alias("drug_score"), "match_status")


@register("fuzzy_match", f"""WITH {_FUZZY} SELECT catalyst_id, CAST(ed AS VARCHAR) AS matched_date, drug AS matched_drug,
  CAST(delta AS DOUBLE) AS date_delta_days, {r('score', 3)} AS drug_score, match_status FROM fm""")
def fuzzy_match(spark, sf):
    return _lev(spark, sf).select(
        "catalyst_id", F.col("matched_date").cast("string"), "matched_drug", F.col("date_delta_days").cast("double"),
        rnd("drug_score", 3).alias("drug_score"), "match_status")


@register("match_status_counts", f"WITH {_FUZZY} SELECT match_status, count(*) AS n FROM fm GROUP BY 1")
def match_status_counts(spark, sf):
    return _lev(spark, sf).groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


@register("suggest_corrections", f"""WITH {_FUZZY} SELECT catalyst_id, ticker, CAST(ed AS VARCHAR) AS announcement_date, delta AS date_delta_days FROM fm
  WHERE match_status LIKE '%DRIFT' AND abs(delta) >= 30 AND round(score, 3) >= 0.7 AND (src IS NULL OR src <> 'PRESS')""")
def suggest_corrections(spark, sf):
    return fuzzy.suggest_corrections(_lev(spark, sf)).select(
        "catalyst_id", "ticker", F.col("announcement_date").cast("string"), "date_delta_days")


@register("largest_drifts", f"""WITH {_FUZZY} SELECT catalyst_id, delta AS date_delta_days FROM fm WHERE match_status LIKE '%DRIFT'
  ORDER BY abs(delta) DESC, catalyst_id LIMIT 20""")
def largest_drifts(spark, sf):
    return fuzzy.largest_drifts(_lev(spark, sf)).select("catalyst_id", "date_delta_days")


@register("new_candidates", f"""WITH {_FUZZY}, half AS (SELECT DISTINCT upper(p_brand) AS tk, p_name AS name FROM part WHERE p_size <= 5),
once AS (SELECT tk, other, ed, min(event_id) AS event_id FROM ext GROUP BY 1, 2, 3)
SELECT tk AS ticker, other AS name, CAST(ed AS VARCHAR) AS event_date, event_id FROM once o WHERE NOT EXISTS (SELECT 1 FROM half h JOIN sc ON sc.name = h.name
  AND sc.other = o.other WHERE h.tk = o.tk AND (sc.score >= 0.6 OR contains(h.name, o.other) OR contains(o.other, h.name)))""")
def new_candidates(spark, sf):
    _, ev = _fuzzy_sides(spark, sf)
    known = inputs.table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_brand").alias("ticker"), F.col("p_name").alias("drug_name"))
    out = fuzzy.new_candidates(ev, known, None, ratio=fuzzy.levenshtein_ratio)
    return out.select("ticker", "name", F.col("event_date").cast("string"), "event_id")
