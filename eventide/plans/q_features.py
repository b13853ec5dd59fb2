"""Queries: market and trial features, exposure, modelling frames, study aggregates, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.functions.rounding import rnd, rnd_wide
from eventide.operators import audits, eventstudy, features, frame, lookup, series, studies
from eventide.operators.ordered import quantiles
from eventide.plans import inputs
from eventide.plans.oracle_base import ALIGNED_ONLY, CUTS, EVTS, FEATURES, LEDGER, STUDIES, TRIALS, endpoint_sql, r, r_wide
from eventide.plans.q_core import _MATCHED, MATCHED_ONLY, _aligned, _study_events
from eventide.session import spread, stable
from eventide.plans.q_pit import _PROG, _programs, _publications, _with_cutoff

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def _bench(spark, sf):
    return series.benchmark_returns(inputs.benchmarks(spark, sf))


_MF_COLS = ("price_at_cutoff", *features.MARKET)


@register("trailing_features", f"""WITH {CUTS}, {FEATURES} SELECT catalyst_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  {', '.join(r_wide(c) + ' AS ' + c for c in _MF_COLS)} FROM cuts JOIN mf USING (ticker, cutoff)""")
def trailing_features(spark, sf):
    ev = _with_cutoff(spark, sf).select("catalyst_id", "ticker", "cutoff")
    mf = features.market_features(ev, inputs.bars(spark, sf), _bench(spark, sf))
    return mf.select("catalyst_id", F.col("as_of_date").cast("string"), *[rnd_wide(c).alias(c) for c in _MF_COLS])


@register("prior_success", f"""WITH {EVTS}, d AS (SELECT drug_name, announcement_date, count(clinical_success) AS n,
    sum(clinical_success) AS s FROM evts GROUP BY 1, 2),
p AS (SELECT a.drug_name, a.announcement_date, coalesce(sum(b.n), 0) AS n, sum(b.s) AS s FROM d a LEFT JOIN d b
  ON a.drug_name = b.drug_name AND b.announcement_date < a.announcement_date GROUP BY 1, 2)
SELECT catalyst_id, CAST(n AS BIGINT) AS n_prior_same_drug, {r('CASE WHEN n > 0 THEN s / n END')}
  AS prior_success_rate_same_drug FROM evts JOIN p USING (drug_name, announcement_date)""")
def prior_success(spark, sf):
    return features.prior_same_drug(inputs.catalysts(spark, sf)).select(
        "catalyst_id", "n_prior_same_drug", rnd("prior_success_rate_same_drug").alias("prior_success_rate_same_drug"))


_DESIGN_SQL = f"""CASE upper(phase) WHEN 'PHASE2' THEN 2e0 WHEN 'PHASE3' THEN 3e0 WHEN 'PHASE1/PHASE2' THEN 1.5::DOUBLE
    ELSE 2e0 END AS phase_numeric, {r('CASE WHEN enrollment > 0 THEN ln(1 + enrollment) END')} AS log_enrollment,
  CASE WHEN upper(allocation) = 'RANDOMIZED' THEN 1 ELSE 0 END AS is_randomized,
  CASE WHEN upper(coalesce(masking, '')) IN ('', 'NONE', 'NA', 'OPEN LABEL') THEN 0 ELSE 1 END AS is_blinded,
  CASE WHEN intervention IN ('["drug a","drug b"]', '["drug a plus drug b"]') THEN 1 ELSE 0 END AS is_combination,
  {endpoint_sql('outcome_text')}"""


def _design(df, *keep):
    return df.select(
        "catalyst_id", *keep,
        sc.phase_numeric(F.col("phase")).alias("phase_numeric"),
        rnd(sc.log_enrollment(F.col("enrollment"))).alias("log_enrollment"),
        sc.is_randomized(F.col("allocation")).alias("is_randomized"),
        sc.is_blinded(F.col("masking")).alias("is_blinded"),
        sc.is_combination(F.col("intervention")).alias("is_combination"),
        *[c.alias(n) for n, c in sc.endpoint_flags(F.col("outcome_text")).items()],
    )


@register("trial_design", f"WITH {TRIALS} SELECT catalyst_id, {_DESIGN_SQL} FROM trials")
def trial_design(spark, sf):
    return _design(inputs.trials(spark, sf))


@register("endpoint_flags", f"SELECT doc_id, {endpoint_sql('text')} FROM documents")
def endpoint_flags(spark, sf):
    d = spread(inputs.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[c.alias(n) for n, c in sc.endpoint_flags(F.col("text")).items()])


_RATES = """rates AS (SELECT p_type AS phase, p_brand AS indication_group, split_part(p_name, ' ', 2) AS modality,
    p_retailprice / 2000e0 AS success_rate, p_partkey AS row_pos FROM part),
probes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_type AS phase,
    'Brand#' || (l_suppkey % 30 + 1) AS grp,
    CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'none' ELSE split_part(p_name, ' ', 2) END END AS modality
  FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT phase, indication_group, modality, arg_min(success_rate, row_pos) AS v FROM rates GROUP BY ALL),
b AS (SELECT phase, indication_group, arg_min(success_rate, row_pos) AS v FROM rates GROUP BY ALL),
c AS (SELECT phase, modality, arg_min(success_rate, row_pos) AS v FROM rates GROUP BY ALL),
d AS (SELECT phase, arg_min(success_rate, row_pos) AS v FROM rates GROUP BY ALL)"""


@register("base_rate_lookup", f"""WITH {_RATES} SELECT l_orderkey, l_linenumber, l_partkey, {r('coalesce(a.v, b.v, c.v, d.v)')}
  AS pos_rate FROM probes p LEFT JOIN a ON a.phase = p.phase AND a.indication_group = p.grp AND a.modality = p.modality
  LEFT JOIN b ON b.phase = p.phase AND b.indication_group = p.grp
  LEFT JOIN c ON c.phase = p.phase AND c.modality = p.modality LEFT JOIN d ON d.phase = p.phase""")
def base_rate_lookup(spark, sf):
    part = inputs.table(spark, sf, "part")
    word = F.split("p_name", " ")[1]
    rates = part.select(F.col("p_type").alias("phase"), F.col("p_brand").alias("indication_group"),
                        word.alias("modality"), (F.col("p_retailprice") / 2000.0).alias("success_rate"),
                        F.col("p_partkey").alias("row_pos"))
    li = inputs.table(spark, sf, "lineitem")
    mod = F.when(F.col("l_linenumber") != 7, F.when(F.col("l_suppkey") % 4 == 0, "none").otherwise(word))
    probes = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p_type").alias("ph"),
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30 + 1).cast("string")).alias("grp"), mod.alias("mod"))
    out = lookup.base_rate(probes, rates, "ph", "grp", "mod", "rate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rnd("rate").alias("pos_rate"))


_TIERS = """tiers AS (SELECT 'Brand#' || (n_nationkey + 1) AS ticker, CASE n_regionkey WHEN 0 THEN 'large_pharma'
    ELSE 'mid_cap' END AS tier FROM nation WHERE n_regionkey < 2),
expo AS (SELECT e.catalyst_id, e.ticker, e.indication, coalesce(t.tier, 'small_cap') AS tier,
    CASE WHEN e.acctbal > 9000 THEN 'sec_edgar' END AS src, e.acctbal FROM evts e LEFT JOIN tiers t USING (ticker)),
exposure AS (SELECT *, CASE WHEN src IS NOT NULL THEN 0.45::DOUBLE WHEN tier = 'large_pharma' THEN 0.20::DOUBLE
    WHEN tier = 'mid_cap' THEN 0.55::DOUBLE ELSE 0.90::DOUBLE END AS company_dependency,
    coalesce(src, 'heuristic_' || tier) AS data_source,
    CASE WHEN src IS NULL THEN CASE WHEN tier = 'small_cap' THEN 1e0 ELSE 0e0 END END AS is_lead_asset FROM expo)"""


def _exposure(spark, sf):
    n = inputs.table(spark, sf, "nation").filter("n_regionkey < 2")
    tiers = n.select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("ticker"),
                     F.when(F.col("n_regionkey") == 0, "large_pharma").otherwise("mid_cap").alias("tier"))
    ev = inputs.catalysts(spark, sf)
    filed = F.col("acctbal") > 9000
    ev = ev.withColumns({"data_source": F.when(filed, "sec_edgar"), "company_dependency": F.when(filed, 0.45)})
    return features.sponsor_exposure(ev, tiers)


@register("sponsor_exposure", f"""WITH {EVTS}, {_TIERS} SELECT catalyst_id, company_dependency, data_source, is_lead_asset
  FROM exposure""")
def sponsor_exposure(spark, sf):
    return _exposure(spark, sf).select("catalyst_id", "company_dependency", "data_source",
                                       F.col("is_lead_asset").cast("double"))


@register("market_cap_dependency", f"""WITH {EVTS} SELECT catalyst_id, CASE WHEN acctbal * 1e7 <= 0 THEN NULL
  WHEN acctbal * 1e7 >= 50e9 THEN 0.15::DOUBLE WHEN acctbal * 1e7 >= 5e9 THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END
  AS company_dependency FROM evts""")
def market_cap_dependency(spark, sf):
    return inputs.catalysts(spark, sf).select(
        "catalyst_id", sc.cap_dependency(F.col("acctbal") * 1e7).alias("company_dependency"))


@register("enhanced_dependency", f"""WITH {EVTS}, {_TIERS}, {TRIALS}, x AS (SELECT e.catalyst_id, e.is_lead_asset AS l,
    CASE WHEN upper(t.phase) = 'PHASE3' THEN 1 ELSE 0 END AS p3, e.company_dependency AS b,
    CASE WHEN e.acctbal > 8000 THEN 1 ELSE 0 END AS lc FROM exposure e JOIN trials t USING (catalyst_id)),
y1 AS (SELECT *, CASE WHEN l = 1 THEN least(1e0, b + 0.05::DOUBLE) ELSE b END AS s1 FROM x),
y2 AS (SELECT *, CASE WHEN l = 1 THEN least(1e0, s1 + 0.05::DOUBLE) ELSE s1 END AS s2 FROM y1),
y3 AS (SELECT *, CASE WHEN p3 = 1 THEN least(1e0, s2 + 0.03::DOUBLE) ELSE s2 END AS s3 FROM y2)
SELECT catalyst_id, {r('CASE WHEN lc = 1 THEN greatest(0.10::DOUBLE, s3 - 0.10::DOUBLE) ELSE s3 END')}
  AS enhanced_dependency FROM y3""")
def enhanced_dependency(spark, sf):
    df = _exposure(spark, sf).join(inputs.trials(spark, sf).select("catalyst_id", "phase"), "catalyst_id")
    enh = sc.enhanced_dependency(F.col("company_dependency"), F.col("is_lead_asset"), F.col("is_single_asset_company"),
                                 sc.phase_numeric(F.col("phase")), (F.col("acctbal") > 8000).cast("int"))
    return df.select("catalyst_id", rnd(enh).alias("enhanced_dependency"))


@register("exposure_adjusted", f"""WITH {LEDGER} SELECT catalyst_id, coalesce(company_dependency, 0.9::DOUBLE) AS company_dependency,
  {r('expected_car * coalesce(company_dependency, 0.9::DOUBLE)', 10)} AS expected_car_adj FROM ledger""")
def exposure_adjusted(spark, sf):
    led = inputs.ledger(spark, sf)
    out = features.exposure_adjusted(led.drop("company_dependency"), led.filter("company_dependency is not null"))
    return out.select("catalyst_id", "company_dependency", rnd("expected_car_adj", 10).alias("expected_car_adj"))


_RISK = LEDGER + """,
frame AS (SELECT l.*, CASE WHEN l.catalyst_id % 13 <> 0 THEN p_failure END AS realized_vol_20d,
    CASE WHEN l.catalyst_id % 7 <> 0 THEN realized_car * 0.9::DOUBLE END AS pre_catalyst_runup_60d,
    CASE WHEN l.catalyst_id % 6 = 0 THEN NULL ELSE (l.catalyst_id % 6) * 0.75::DOUBLE END AS phase_numeric,
    CASE l.catalyst_id % 4 WHEN 0 THEN 'EFFICACY_FAILURE' WHEN 1 THEN 'SAFETY_FAILURE' WHEN 2 THEN 'SUCCESS' END AS outcome_category
  FROM ledger l),
med AS (SELECT quantile_cont(realized_vol_20d, 0.5) AS m FROM frame),
risk AS (SELECT catalyst_id, test_year, indication, clinical_success, realized_car, pre_catalyst_runup_60d,
    CASE WHEN clinical_success = 0 THEN 1 ELSE 0 END AS clinical_failure,
    CASE WHEN outcome_category LIKE '%FAILURE' THEN 1 ELSE 0 END AS efficacy_safety_failure,
    CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1 ELSE 0 END AS major_negative_event,
    CASE WHEN realized_car <= (-0.40)::DOUBLE THEN 1 ELSE 0 END AS catastrophic_drop,
    coalesce(company_dependency, 0.9::DOUBLE) AS company_dependency,
    CASE WHEN coalesce(company_dependency, 0.9::DOUBLE) >= 0.85::DOUBLE THEN 1 ELSE 0 END AS is_small_cap,
    CASE WHEN coalesce(company_dependency, 0.9::DOUBLE) <= 0.25::DOUBLE THEN 1 ELSE 0 END AS is_large_cap,
    CASE WHEN coalesce(pre_catalyst_runup_60d, 0) > 0.15::DOUBLE THEN 1 ELSE 0 END AS high_momentum,
    CASE WHEN coalesce(realized_vol_20d, 0) > m THEN 1 ELSE 0 END AS high_volatility,
    CASE WHEN coalesce(company_dependency, 0.9::DOUBLE) >= 0.80::DOUBLE THEN 1 ELSE 0 END AS high_dependency,
    CASE WHEN coalesce(phase_numeric, 0) >= 3 THEN 1 ELSE 0 END AS phase_3,
    CASE WHEN coalesce(phase_numeric, 0) >= 2 AND coalesce(phase_numeric, 0) < 3 THEN 1 ELSE 0 END AS phase_2
  FROM frame, med)"""

_FLAGS = ("clinical_failure", "efficacy_safety_failure", "major_negative_event", "catastrophic_drop", "is_small_cap",
          "is_large_cap", "high_momentum", "high_volatility", "high_dependency", "phase_3", "phase_2")


def risk_frame(spark, sf):
    key = F.col("catalyst_id")
    cat = F.element_at(F.array(F.lit("EFFICACY_FAILURE"), F.lit("SAFETY_FAILURE"), F.lit("SUCCESS"),
                               F.lit(None).cast("string")), (key % 4 + 1).cast("int"))
    led = inputs.ledger(spark, sf).withColumns({
        "realized_vol_20d": F.when(key % 13 != 0, F.col("p_failure")),
        "pre_catalyst_runup_60d": F.when(key % 7 != 0, F.col("realized_car") * 0.9),
        "phase_numeric": F.when(key % 6 != 0, (key % 6) * 0.75),
        "outcome_category": cat,
    })
    return features.risk_flags(led)


@register("risk_flags", f"WITH {_RISK} SELECT catalyst_id, company_dependency, {', '.join(_FLAGS)} FROM risk")
def risk_flags(spark, sf):
    return risk_frame(spark, sf).select("catalyst_id", "company_dependency", *_FLAGS)


@register("feature_set", f"""WITH {TRIALS} SELECT catalyst_id, {_DESIGN_SQL.replace(endpoint_sql('outcome_text'), '')}
  NULL::DOUBLE AS wong_pos_rate FROM trials""")
def feature_set(spark, sf):
    d = _design(inputs.trials(spark, sf)).drop("endpoint_safety")
    out = features.with_feature_set(d, "clinical_only", ["catalyst_id"])
    return out.select("catalyst_id", "phase_numeric", "log_enrollment", "is_randomized", "is_blinded",
                      "is_combination", "wong_pos_rate")


@register("study_aggregates_v1", f"""WITH {STUDIES}, v AS (SELECT * FROM studies WHERE verification_status = 'verified'),
m AS (SELECT program_id, effect_size, row_number() OVER (PARTITION BY program_id ORDER BY effect_size) - 1 AS i,
    count(*) OVER (PARTITION BY program_id) AS n FROM v),
a AS (SELECT program_id, count(*) AS n, count(DISTINCT species) AS s, count(DISTINCT disease_model) AS dm,
    max(effect_size) AS best, max(CASE WHEN survival_benefit = 1 THEN 1 ELSE 0 END) AS sb, avg(randomized) AS pr,
    avg(blinded) AS pb FROM v GROUP BY 1)
SELECT o_orderkey AS program_id, coalesce(a.n, 0) AS n_animal_studies, CAST(s AS DOUBLE) AS n_species,
  CAST(dm AS DOUBLE) AS n_models, best AS best_effect_size, m.effect_size AS median_effect_size,
  CAST(sb AS DOUBLE) AS any_survival_benefit, {r('pr')} AS pct_studies_randomized, {r('pb')} AS pct_studies_blinded
FROM orders LEFT JOIN a ON a.program_id = o_orderkey LEFT JOIN m ON m.program_id = o_orderkey AND m.i = m.n // 2""")
def study_aggregates_v1(spark, sf):
    progs = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("program_id"))
    out = studies.program_aggregates_v1(progs, inputs.studies(spark, sf))
    return out.select("program_id", "n_animal_studies", F.col("n_species").cast("double"),
                      F.col("n_models").cast("double"), "best_effect_size", "median_effect_size",
                      F.col("any_survival_benefit").cast("double"),
                      rnd("pct_studies_randomized").alias("pct_studies_randomized"),
                      rnd("pct_studies_blinded").alias("pct_studies_blinded"))


@register("study_aggregates_v2", f"""WITH {STUDIES}, v AS (SELECT *, row_number() OVER (PARTITION BY program_id
    ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM studies WHERE verification_status = 'verified')
SELECT program_id, count(*) AS n_animal_studies, count(DISTINCT species) AS n_species,
  count(DISTINCT disease_model) AS n_models, max(effect_size) AS best_effect_size, min(p_value) AS min_p_value,
  max(CASE WHEN coalesce(survival_benefit, 0) > 0 THEN 1 ELSE 0 END) AS survival_benefit_any,
  {r('avg(randomized)')} AS pct_studies_randomized, {r('avg(blinded)')} AS pct_studies_blinded,
  {r('avg(face_validity)')} AS mean_face_validity, max(CASE WHEN rn = 1 THEN disease_model END) AS first_model,
  {r('quantile_cont(effect_size, 0.5)')} AS median_effect_size FROM v GROUP BY 1""")
def study_aggregates_v2(spark, sf):
    out = studies.program_aggregates_v2(inputs.studies(spark, sf))
    rounded = {c: rnd(c) for c in ("pct_studies_randomized", "pct_studies_blinded", "mean_face_validity",
                                   "median_effect_size")}
    return out.withColumns(rounded)


@register("study_level_frame", f"""WITH {STUDIES}, {EVTS} SELECT s.program_id, s.l_partkey, s.l_linenumber, e.ticker,
  e.drug_name, CAST(year(e.announcement_date) AS INTEGER) AS t0_year, e.clinical_success, s.effect_size, s.p_value,
  s.species, s.disease_model FROM studies s JOIN evts e ON e.catalyst_id = s.program_id
WHERE s.verification_status = 'verified' AND e.clinical_success IS NOT NULL""")
def study_level_frame(spark, sf):
    ev = inputs.catalysts(spark, sf).filter("clinical_success is not null").select(
        F.col("catalyst_id").alias("program_id"), "ticker", "drug_name",
        F.year("announcement_date").alias("t0_year"), "clinical_success")
    v = studies.verified(inputs.studies(spark, sf))
    return v.join(ev, "program_id").select(
        "program_id", "study_id.l_partkey", "study_id.l_linenumber", "ticker", "drug_name", "t0_year",
        "clinical_success", "effect_size", "p_value", "species", "disease_model")


@register("program_table", f"""WITH {STUDIES}, {EVTS}, {TRIALS}, a AS (SELECT program_id, count(*) AS n, avg(randomized) AS pr
    FROM studies WHERE verification_status = 'verified' GROUP BY 1)
SELECT e.catalyst_id AS program_id, e.drug_name, e.indication, e.ticker, CAST(e.clinical_success AS DOUBLE) AS clinical_success,
  coalesce(a.n, 0) AS n_animal_studies, {r('a.pr')} AS pct_studies_randomized, t.phase, CAST(t.enrollment AS DOUBLE) AS enrollment
FROM evts e LEFT JOIN a ON a.program_id = e.catalyst_id LEFT JOIN trials t USING (catalyst_id)""")
def program_table(spark, sf):
    agg = studies.verified(inputs.studies(spark, sf)).groupBy(F.col("program_id").alias("catalyst_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("randomized").alias("pr"))
    ev = inputs.catalysts(spark, sf)
    t = inputs.trials(spark, sf).select("catalyst_id", "phase", "enrollment")
    return ev.join(agg, "catalyst_id", "left").join(t, "catalyst_id", "left").select(
        F.col("catalyst_id").alias("program_id"), "drug_name", "indication", "ticker",
        F.col("clinical_success").cast("double"), F.coalesce("n", F.lit(0).cast("long")).alias("n_animal_studies"),
        rnd("pr").alias("pct_studies_randomized"), "phase", F.col("enrollment").cast("double"))


@register("programs_prospective_view", f"""WITH {_PROG}, bad AS (SELECT DISTINCT program_id FROM pubs JOIN progs USING (program_id)
  WHERE least(publication_date, online_first_date) IS NULL OR least(publication_date, online_first_date) > t0_date)
SELECT progs.program_id, CAST(t0_date AS VARCHAR) AS t0_date,
  t0_date IS NOT NULL AND bad.program_id IS NULL AS leakage_passed FROM progs LEFT JOIN bad USING (program_id)""")
def programs_prospective_view(spark, sf):
    progs = _programs(spark, sf)
    log = audits.leakage_audit(progs, _publications(spark, sf))
    passed = log.groupBy("program_id").agg(F.min("passed").alias("leakage_passed"))
    return progs.join(passed, "program_id", "left").select(
        "program_id", F.col("t0_date").cast("string"), "leakage_passed")


@register("catalysts_prospective_view", f"""WITH {_MATCHED} SELECT e.catalyst_id, e.ticker,
  {r("max(car) FILTER (WHERE benchmark = 'MARKET_MODEL')")} AS car_m1_p1_spy,
  {r("max(car) FILTER (WHERE benchmark = 'XBI_MODEL')")} AS car_m1_p1_xbi
FROM evts e LEFT JOIN (SELECT * FROM long WHERE window_label = '[-1,+1]') l USING (ticker, announcement_date) GROUP BY 1, 2""")
def catalysts_prospective_view(spark, sf):
    bars, al = _aligned(spark, sf)
    es = eventstudy.event_study(_study_events(spark, sf), al, bars)
    keep = F.col("window_label").isNull() | (F.col("window_label") == "[-1,+1]")
    pick = lambda b: F.max(F.when(F.col("benchmark") == b, F.col("car")))
    return es.filter(keep).groupBy("catalyst_id", "ticker").agg(
        rnd(pick("MARKET_MODEL")).alias("car_m1_p1_spy"), rnd(pick("XBI_MODEL")).alias("car_m1_p1_xbi"))


_PRIOR_SQL = """drug_days AS (SELECT drug_name, announcement_date, count(clinical_success) AS n, sum(clinical_success) AS s FROM evts GROUP BY 1, 2),
prior AS (SELECT a.drug_name, a.announcement_date, coalesce(sum(b.n), 0) AS n, sum(b.s) AS s FROM drug_days a LEFT JOIN drug_days b
  ON a.drug_name = b.drug_name AND b.announcement_date < a.announcement_date GROUP BY 1, 2)"""

#: base: the modelling frame with every column; frame: with exposure and risk flags, rows that have a CAR.
FRAME_BASE = ",\n".join((CUTS, FEATURES, ALIGNED_ONLY, MATCHED_ONLY, TRIALS, _PRIOR_SQL, STUDIES)) + f""",
design AS (SELECT catalyst_id, phase, {_DESIGN_SQL} FROM trials),
rate AS (SELECT phase, avg(clinical_success) AS v FROM evts JOIN trials USING (catalyst_id) WHERE announcement_date < DATE '1993-01-01' GROUP BY 1),
evidence AS (SELECT c.catalyst_id, count(*) AS n, count(*) FILTER (WHERE verification_status = 'verified') AS v,
    list_sort(list(effect_size) FILTER (WHERE verification_status = 'verified' AND effect_size IS NOT NULL)) AS effects
  FROM cuts c JOIN orders o ON o.o_custkey = c.company_id JOIN studies s ON s.program_id = o.o_orderkey AND s.publication_date <= c.cutoff GROUP BY 1),
base AS (SELECT c.catalyst_id, c.ticker, c.indication, c.announcement_date, CAST(year(c.announcement_date) AS INTEGER) AS catalyst_year, c.clinical_success,
    c.cutoff, l.car AS realized_car, {', '.join(f'mf.{c}' for c in features.MARKET)}, mf.as_of_date,
    mf.as_of_date IS NOT NULL AS market_features_point_in_time, c.catalyst_id % 5 <= 3 AS trial_features_point_in_time,
    {', '.join(f"CASE WHEN c.catalyst_id % 5 <= 3 THEN d.{x} END AS {x}" for x in features.CLINICAL[:8])},
    CASE WHEN c.catalyst_id % 5 <= 3 AND c.cutoff >= DATE '1993-01-01' THEN rate.v END AS wong_pos_rate,
    CASE WHEN c.catalyst_id % 5 <= 3 THEN p.n END AS n_prior_same_drug,
    CASE WHEN c.catalyst_id % 5 <= 3 AND p.n > 0 THEN p.s / p.n END AS prior_success_rate_same_drug,
    CASE WHEN e.n > 0 THEN 1 ELSE 0 END AS preclinical_evidence_found, coalesce(e.n, 0) AS n_preclinical_publications,
    coalesce(e.v, 0) AS n_animal_studies, e.effects[len(e.effects) // 2 + 1] AS median_effect_size
  FROM cuts c JOIN long l ON l.ticker = c.ticker AND l.announcement_date = c.announcement_date
    AND l.window_label = '[-1,+1]' AND l.benchmark = 'MARKET_MODEL'
  LEFT JOIN mf ON mf.ticker = c.ticker AND mf.cutoff = c.cutoff LEFT JOIN design d ON d.catalyst_id = c.catalyst_id
  LEFT JOIN rate ON rate.phase = d.phase LEFT JOIN prior p ON p.drug_name = c.drug_name AND p.announcement_date = c.announcement_date
  LEFT JOIN evidence e ON e.catalyst_id = c.catalyst_id WHERE c.clinical_success IS NOT NULL AND l.car IS NOT NULL)"""
FRAME = FRAME_BASE + f""",
{_TIERS}, exposed AS (SELECT b.*, b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) <= b.cutoff AS company_features_point_in_time,
    CASE WHEN b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) <= b.cutoff THEN x.company_dependency END AS dep,
    CASE WHEN b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) <= b.cutoff THEN x.is_lead_asset END AS is_lead_asset,
    CASE WHEN b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) <= b.cutoff THEN x.is_lead_asset END AS is_single_asset_company,
    CASE WHEN b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) <= b.cutoff
      THEN b.announcement_date + CAST(b.catalyst_id % 6 - 5 AS INTEGER) END AS expo_date,
    CASE WHEN b.catalyst_id % 5 <= 3 THEN b.cutoff + CAST(b.catalyst_id % 5 - 3 AS INTEGER) END AS trial_date
  FROM base b JOIN exposure x USING (catalyst_id)),
frame AS MATERIALIZED (SELECT * EXCLUDE (dep), coalesce(dep, 0.9::DOUBLE) AS company_dependency, greatest(as_of_date, expo_date, trial_date) AS feature_as_of_date,
    CASE WHEN coalesce(realized_vol_20d, 0) > (SELECT quantile_cont(realized_vol_20d, 0.5) FROM exposed) THEN 1 ELSE 0 END AS high_volatility,
    CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1 ELSE 0 END AS major_negative_event,
    CASE WHEN clinical_success = 0 THEN 1 ELSE 0 END AS clinical_failure FROM exposed)"""


#: The base-rate table counts as published on this day; it averages outcomes of the years before.
RATES_PUBLISHED = "1993-01-01"


def _published_rates(ev, trials_):
    """Base rates by phase as a table published before the study: outcomes before its date only."""
    known = ev.filter(F.col("announcement_date") < F.lit(RATES_PUBLISHED).cast("date")).join(trials_.select("catalyst_id", "phase"), "catalyst_id")
    null = F.lit(None).cast("string")
    return known.groupBy("phase").agg(F.avg("clinical_success").alias("success_rate")).select(
        "phase", null.alias("indication_group"), null.alias("modality"), "success_rate", F.col("phase").alias("row_pos"))


def modeling_inputs(spark, sf):
    """(events with cutoffs, market features, CAR, trial design with its snapshot time, history and published base rate,
    preclinical evidence of the issuer's studies at the cutoff). An event whose cutoff precedes the rate table has no rate."""
    ev = _with_cutoff(spark, sf)
    bars, al = _aligned(spark, sf)
    mf = features.market_features(ev.select("catalyst_id", "ticker", "cutoff"), bars, _bench(spark, sf))
    car = eventstudy.primary_car(ev.select("catalyst_id", "ticker", "announcement_date"), al, bars)
    trials_ = inputs.trials(spark, sf)
    seen = F.date_add("cutoff", (F.col("catalyst_id") % 5 - 3).cast("int"))
    prior = features.prior_same_drug(ev.select("catalyst_id", "drug_name", "announcement_date", "clinical_success", "cutoff"))
    trial = _design(trials_, "phase").drop("endpoint_safety").join(
        prior.select("catalyst_id", "n_prior_same_drug", "prior_success_rate_same_drug", "cutoff", seen.alias("trial_source_observed_at")), "catalyst_id")
    none = F.lit(None).cast("string")
    trial = lookup.base_rate(trial.withColumns({"_grp": none, "_mod": none}), _published_rates(ev, trials_), "phase", "_grp", "_mod", "_rate")
    published = F.col("cutoff") >= F.lit(RATES_PUBLISHED).cast("date")
    trial = trial.withColumn("wong_pos_rate", F.when(published, F.col("_rate"))).drop("_grp", "_mod", "_rate", "phase", "cutoff")
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("program_id"), F.col("o_custkey").alias("company_id"))
    issuer = spread(orders, "program_id", rows=orders.count())
    evidence = inputs.studies(spark, sf).join(issuer, "program_id")
    pre = studies.preclinical_as_of(ev.select("catalyst_id", "company_id", "cutoff"), evidence, "company_id")
    return ev, mf.drop("ticker", "cutoff"), car.select("catalyst_id", "car"), trial, pre


def modeling_frame(spark, sf, labelled_only=True, car_join="left"):
    """Events with CAR, market, trial and preclinical features; a family unproven at the cutoff is nulled."""
    ev, mf, car, trial, pre = modeling_inputs(spark, sf)
    return frame.modelling_rows(ev, car, mf, trial, pre, labelled_only, car_join)


_FRAME_OUT = ("realized_car", *features.MARKET, *(c for c in features.CLINICAL if c not in ("n_prior_same_drug",)), "median_effect_size")
_FRAME_WHOLE = ("n_prior_same_drug", "preclinical_evidence_found", "n_preclinical_publications", "n_animal_studies")
_FRAME_FLAGS = ("market_features_point_in_time", "trial_features_point_in_time")


@register("modeling_frame", f"""WITH {FRAME_BASE} SELECT catalyst_id, {', '.join(f"{r_wide(c)} AS {c}" for c in _FRAME_OUT)},
  {', '.join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FRAME_WHOLE)}, {', '.join(_FRAME_FLAGS)} FROM base""")
def modeling_frame_query(spark, sf):
    return modeling_frame(spark, sf).select(
        "catalyst_id", *[rnd_wide(F.col(c).cast("double")).alias(c) for c in _FRAME_OUT], *[F.col(c).cast("double") for c in _FRAME_WHOLE], *_FRAME_FLAGS)


def short_edge_frame(spark, sf):
    """Modelling rows with a CAR and exposure sanitised as a third family; the risk flags are derived from it."""
    base = modeling_frame(spark, sf, labelled_only=True, car_join="inner")
    expo = _exposure(spark, sf).select("catalyst_id", "company_dependency", "is_lead_asset", "is_single_asset_company",
                                       F.date_add("announcement_date", (F.col("catalyst_id") % 6 - 5).cast("int"))
                                       .alias("exposure_as_of"))
    return frame.with_exposure(base, expo)


@register("short_edge_frame", f"""WITH {FRAME} SELECT catalyst_id, company_dependency, CAST(feature_as_of_date AS VARCHAR) AS feature_as_of_date,
  high_volatility, major_negative_event, {r('wong_pos_rate')} AS wong_pos_rate, CAST(n_prior_same_drug AS DOUBLE) AS n_prior_same_drug,
  {r('prior_success_rate_same_drug')} AS prior_success_rate_same_drug, CAST(n_animal_studies AS DOUBLE) AS n_animal_studies,
  {r('median_effect_size')} AS median_effect_size FROM frame""")
def short_edge_frame_query(spark, sf):
    df = features.risk_flags(stable(short_edge_frame(spark, sf)))
    return df.select("catalyst_id", "company_dependency", F.col("feature_as_of_date").cast("string"), "high_volatility", "major_negative_event",
                     rnd("wong_pos_rate").alias("wong_pos_rate"), F.col("n_prior_same_drug").cast("double"),
                     rnd("prior_success_rate_same_drug").alias("prior_success_rate_same_drug"), F.col("n_animal_studies").cast("double"),
                     rnd("median_effect_size").alias("median_effect_size"))


@register("enrich_missing", f"WITH {_RISK} SELECT catalyst_id, test_year, phase_2, phase_3, is_small_cap FROM risk")
def enrich_missing(spark, sf):
    """Columns the predictions lack are brought from the flagged frame; those they have stay."""
    preds = inputs.ledger(spark, sf).select("catalyst_id", "test_year")
    wanted = ["test_year", "phase_2", "phase_3", "is_small_cap", "not_there"]
    out = features.enrich_missing(preds, risk_frame(spark, sf), "catalyst_id", wanted)
    return out.select("catalyst_id", "test_year", "phase_2", "phase_3", "is_small_cap")


@register("expected_short_return", f"""WITH {LEDGER}, x AS (SELECT catalyst_id, coalesce(company_dependency, 0.9::DOUBLE) AS d, p_failure AS p,
    realized_car * 0.5::DOUBLE - 0.1::DOUBLE AS f, realized_car * 0.5::DOUBLE + 0.1::DOUBLE AS s FROM ledger)
SELECT catalyst_id, {r('p * f + (1 - p) * s', 10)} AS expected_car, {r('p * f * d + (1 - p) * s * d', 10)} AS expected_car_exposed,
  {r('-(p * f * d + (1 - p) * s * d) - 2e0 * (25e0 / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0)', 10)} AS net_expected_short_return FROM x""")
def expected_short_return(spark, sf):
    x = inputs.ledger(spark, sf).select(
        "catalyst_id", F.coalesce("company_dependency", F.lit(0.9)).alias("d"), F.col("p_failure").alias("p"),
        (F.col("realized_car") * 0.5 - 0.1).alias("f"), (F.col("realized_car") * 0.5 + 0.1).alias("s"))
    p, f, s, d = (F.col(c) for c in "pfsd")
    exposed = sc.expected_car(p, f, s, d)
    return x.select("catalyst_id", rnd(sc.expected_car(p, f, s), 10).alias("expected_car"),
                    rnd(exposed, 10).alias("expected_car_exposed"),
                    rnd(sc.short_return(exposed), 10).alias("net_expected_short_return"))




def _study_sql(where):
    from eventide.plans.oracle_base import ALIGNED

    cut = ALIGNED.replace("FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
                          f"FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY 1, 2", 1)
    return f"""(WITH {cut}, {EVTS}, {MATCHED_ONLY} SELECT catalyst_id FROM evts JOIN guarded USING (ticker, announcement_date) WHERE price_status = 'ok')"""


@register("recovery_delta", f"""WITH a AS {_study_sql("l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1999-01-01'")}, b AS {_study_sql('true')}
SELECT (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM b) AS n_after,
  (SELECT count(*) FROM b WHERE catalyst_id NOT IN (SELECT catalyst_id FROM a)) AS n_recovered,
  (SELECT count(*) FROM orders) - (SELECT count(*) FROM b) AS n_still_missing""")
def recovery_delta(spark, sf):
    """Events with a CAR before and after late bars are merged into the stored history."""
    def daily(df):
        p = inputs.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
        return df.join(p, df.l_partkey == p.p_partkey).groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(
            F.avg("l_extendedprice").alias("adj_close"))

    li = inputs.table(spark, sf, "lineitem")
    old = daily(li.filter("l_linestatus = 'F' and l_shipdate < '1999-01-01'"))
    bench, ev = _bench(spark, sf), _study_events(spark, sf)
    before, after = (
        eventstudy.primary_car(ev, series.align(series.simple_returns(b), bench), b).select("catalyst_id")
        for b in (old, daily(li)))
    return eventstudy.recovery_delta(ev, before, after)
