"""Masks, exposure, resolution, audits and registry rules on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators import audits, cutoffs, features, lookup, registry

D = dt.date


def test_mask_and_sanitize(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, 1), D(2020, 1, 2), 5.0), (2, D(2020, 1, 3), D(2020, 1, 2), 6.0), (3, None, D(2020, 1, 2), 7.0)],
        "id int, obs date, cut date, f double")
    got = {r["id"]: (r["ok"], r["f"]) for r in cutoffs.sanitize_family(df, ["f", "absent"], "obs", "cut", "ok").collect()}
    assert got == {1: (True, 5.0), 2: (False, None), 3: (False, None)}


def test_later_on_the_cutoff_day_fails_the_mask_but_not_the_audit(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 2, 9), D(2020, 1, 2))], "catalyst_id int, observed_at timestamp, cutoff_date date")
    assert df.select(cutoffs.point_in_time(F.col("observed_at"), F.col("cutoff_date"))).first()[0] is False
    assert audits.cutoff_violations(df, [("c", "FAIL", df)]).count() == 0


def test_facts_as_of_picks_the_known_filing(spark):
    facts = spark.createDataFrame(
        [(1, "Cash", D(2018, 11, 1), D(2018, 9, 30), 0, 100.0), (1, "Cash", D(2019, 2, 20), D(2018, 12, 31), 1, 200.0),
         (1, "Old", D(2018, 1, 1), D(2017, 12, 31), 0, 5.0), (1, "Cash", D(2018, 11, 1), D(2018, 9, 30), 2, 111.0)],
        "cik int, tag string, filed date, end date, pos int, val double")
    probe = spark.createDataFrame([(1, D(2019, 1, 15)), (1, D(2018, 6, 1))], "cik int, cutoff date")
    out = lookup.facts_as_of(probe, facts, {"cash": ("Cash", "Old")}, F.lit(0)).collect()
    assert {r["cutoff"]: r["fact"]["val"] for r in out} == {D(2019, 1, 15): 100.0, D(2018, 6, 1): 5.0}


def test_ticker_candidates(spark):
    m = spark.createDataFrame([("NEW", D(2019, 1, 1), "OLD", 0)], "current_ticker string, before_date date, use_ticker string, pos long")
    ev = spark.createDataFrame([("new", D(2018, 1, 1)), ("NEW", D(2020, 1, 1))], "ticker string, announcement_date date")
    got = {(r["announcement_date"].year, r["rank"]): r["candidate"] for r in lookup.ticker_candidates(ev, m).collect()}
    assert got == {(2018, 1): "OLD", (2018, 2): "NEW", (2020, 1): "NEW"}


def test_covering_candidate_falls_back_to_own(spark):
    c = spark.createDataFrame([("A", D(2020, 6, 1), "B", 1), ("A", D(2020, 6, 1), "A", 2)], "ticker string, announcement_date date, candidate string, rank int")
    bars = spark.createDataFrame([("A", D(2020, 1, 1)), ("A", D(2020, 5, 26)), ("B", D(2020, 1, 1))], "ticker string, date date")
    assert lookup.covering_candidate(c, bars).first()["ticker_used"] == "A"
    none = lookup.covering_candidate(c, bars.filter("ticker = 'B'")).first()
    assert (none["ticker_used"], none["n_bars"]) == ("A", 0)


def test_base_rate_levels(spark):
    rates = spark.createDataFrame(
        [("PHASE2", "oncology", "antibody", 0.3, 0), ("PHASE2", "oncology", None, 0.25, 1), ("PHASE2", "other", "gene", 0.4, 2), ("PHASE3", "other", "x", 0.6, 3)],
        "phase string, indication_group string, modality string, success_rate double, row_pos long")
    q = spark.createDataFrame([(1, "PHASE2", "oncology", "antibody"), (2, "PHASE2", "oncology", None), (3, "PHASE2", "cns", "gene"), (4, "PHASE3", "cns", "gene"), (5, "PHASE1", "a", "b")],
                              "id int, p string, g string, m string")
    got = {r["id"]: r["rate"] for r in lookup.base_rate(q, rates, "p", "g", "m", "rate").collect()}
    assert got == {1: 0.3, 2: 0.3, 3: 0.4, 4: 0.6, 5: None}


def test_exposure_tiers_keep_filed_rows(spark):
    ev = spark.createDataFrame([(1, "big", None, None), (2, "tiny", None, None), (3, "big", 0.45, "sec_edgar")],
                               "catalyst_id int, ticker string, company_dependency double, data_source string")
    tiers = spark.createDataFrame([("BIG", "large_pharma")], "ticker string, tier string")
    got = {r["catalyst_id"]: (r["company_dependency"], r["data_source"], r["is_lead_asset"]) for r in features.sponsor_exposure(ev, tiers).collect()}
    assert got == {1: (0.20, "heuristic_large_pharma", 0), 2: (0.90, "heuristic_small_cap", 1), 3: (0.45, "sec_edgar", None)}


def test_text_flags(spark):
    df = spark.createDataFrame([("Overall survival; PFS",), ("cosy plos",), ("éos",), ("Adverse event, MTD",)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in sc.endpoint_flags(F.col("t")).items()]).collect()]
    assert got == [(1, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)]


def test_dates(spark):
    df = spark.createDataFrame([("2015",), ("2015-3",), ("2015-Mar-07",), ("2015-02-31",), ("2015-xx",), (None,)], "t string")
    got = [r[0] for r in df.select(sc.partial_date(F.col("t"))).collect()]
    assert got == [D(2015, 1, 1), D(2015, 3, 1), D(2015, 3, 7), None, None, None]
    m = spark.createDataFrame([("3/7/2019",), ("43531",)], "t string").select(sc.mixed_date(F.col("t"))).collect()
    assert [r[0] for r in m] == [D(2019, 3, 7), D(2019, 3, 7)]


def test_category_rules_differ(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1), (1, 1, 0, 0)], "s int, t int, f int, u int")
    c = lambda n: F.col(n)
    got = df.select(sc.outcome_category(c("s"), c("t"), c("f"), c("u")), registry.expand_category(c("s"), c("t"), c("f"))).collect()
    assert [tuple(r) for r in got] == [("MIXED", "EFFICACY_FAILURE"), ("SUCCESS", "SAFETY_FAILURE"), ("UNKNOWN", "EFFICACY_FAILURE"), ("SUCCESS", "EFFICACY_FAILURE")]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b")], "k int, v double, s string")
    new = spark.createDataFrame([(2, None, None), (3, 30.0, "c")], "k int, v double, s string")
    got = {r["k"]: (r["v"], r["s"]) for r in registry.upsert(old, new, ["k"], keep_old_if_null=["v"]).collect()}
    assert got == {1: (10.0, "a"), 2: (20.0, None), 3: (30.0, "c")}


def test_feature_sets_expand_once():
    cols = features.resolve_features("clinical_plus_human")
    assert cols == list(features.CLINICAL)
    assert features.split_features("market_plus_trial")[1] == list(features.MARKET)
    assert len(features.resolve_features("everything")) == 11 + 3 + 11 + 4


@pytest.mark.parametrize("year,want", [(2016, "train"), (2018, "validation"), (2019, "test"), (None, "train")])
def test_temporal_split(spark, year, want):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(cutoffs.temporal_split(F.col("y"))).first()[0] == want


def test_cohort_predicates(spark):
    rows = [("PHASE1/PHASE2", "Phase 2b", "2011-05-01"), ("phase3", "phase 1", "2014-01-01"), (None, None, None), ("PHASE3", "in PHASE 3", "2010-01-01")]
    df = spark.createDataFrame(rows, "phase string, stage string, d string").withColumn("d", F.to_date("d"))
    got = df.select(cutoffs.phase_has(F.col("phase"), "2"), cutoffs.stage_mentions(F.col("stage"), "2", "3"), cutoffs.in_t0_window(F.col("d"), 2010, 2012)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, True), (False, True, True)]


def test_violations_are_dealt_out_by_the_number_of_cutoffs(spark):
    """A task joins and counts about 250,000 events, however many there are."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range((n + 2) * 250_000).selectExpr("id as catalyst_id", "date'2020-01-01' as cutoff_date")
    seen = spark.range(1000).selectExpr("id as catalyst_id", "timestamp'2020-01-02' as observed_at")
    found = audits.cutoff_violations(many, [("late", "FAIL", seen), ("again", "UNVERIFIED", seen)])
    assert found.rdd.getNumPartitions() == n + 2
    got = {tuple(r) for r in audits.audit_summary(found).collect()}
    assert got == {("late", 1000, 0, 1000), ("again", 0, 1000, 1000), ("ALL", 1000, 1000, 1000)}
