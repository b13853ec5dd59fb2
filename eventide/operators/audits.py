"""Leakage and coverage audits: long tables of findings and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.session import spread


def cutoff_violations(cutoffs: DataFrame, observations: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Rows observed on a later calendar day than the event's cutoff.

    `cutoffs`: catalyst_id, cutoff_date. `observations`: (check, severity, frame with catalyst_id and
    observed_at). The observation frames are stacked first, so the cutoffs are joined once. They are dealt out by event over as many
    tasks as the number of cutoffs asks for; counts of events in the findings need no other shuffle.
    """
    stacked = [
        obs.select(
            "catalyst_id",
            F.lit(check).alias("check"),
            F.lit(severity).alias("severity"),
            F.col("observed_at").cast("timestamp").alias("observed_at"),
        )
        for check, severity, obs in observations
    ]
    rows = reduce(DataFrame.unionByName, stacked).filter(F.col("observed_at").isNotNull())
    known = spread(cutoffs.select("catalyst_id", "cutoff_date"), "catalyst_id", rows=cutoffs.count())
    return rows.join(known, "catalyst_id").filter(
        F.to_date("observed_at") > F.col("cutoff_date")
    )


def audit_summary(findings: DataFrame) -> DataFrame:
    """One row per check plus an `ALL` row: violations, unverified rows, events affected."""
    both = F.array(F.col("check"), F.lit("ALL"))
    return (
        findings.select("catalyst_id", "severity", F.explode(both).alias("check"))
        .groupBy("check")
        .agg(
            F.count(F.when(F.col("severity") == "FAIL", 1)).alias("violations"),
            F.count(F.when(F.col("severity") == "UNVERIFIED", 1)).alias("unverified"),
            F.countDistinct("catalyst_id").alias("affected_catalysts"),
        )
    )


def market_feature_check(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Whether each event has market features dated on or before its entry cutoff (or announcement).

    `features`: catalyst_id, as_of_date. `cutoffs`: catalyst_id, entry_cutoff_date, announcement_date.
    """
    joined = cutoffs.join(
        features.withColumn("_has", F.lit(True)), "catalyst_id", "left"
    ).withColumn("_cut", F.coalesce("entry_cutoff_date", "announcement_date"))
    late = F.col("as_of_date") > F.col("_cut")
    text = F.concat(
        F.lit("as_of "), F.col("as_of_date").cast("string"), F.lit(" > cutoff "), F.col("_cut").cast("string")
    )
    check = (
        F.when(F.col("_has").isNull(), "market_features_exist")
        .when(F.col("_cut").isNull(), "cutoff_defined")
        .otherwise("market_features_before_cutoff")
    )
    detail = (
        F.when(F.col("_has").isNull(), "no features")
        .when(F.col("_cut").isNull(), "no cutoff")
        .when(late, text)
    )
    return joined.select(
        "catalyst_id", check.alias("check_type"), detail.isNull().alias("passed"), detail.alias("detail")
    )


def leakage_audit(programs: DataFrame, studies: DataFrame) -> DataFrame:
    """t0 and publication checks, one row per program and check.

    `programs`: program_id, t0_date. `studies` (verified): program_id, study_no, study_name,
    publication_date, online_first_date. The first offending study in `study_no` order is reported.
    """
    effective = F.least("publication_date", "online_first_date")
    detail = F.when(
        effective.isNull(), F.concat(F.lit("study "), F.col("study_name"), F.lit(": missing publication date"))
    ).when(
        effective > F.col("t0_date"),
        F.concat(
            F.lit("study "), F.col("study_name"), F.lit(": effective date "), effective.cast("string"),
            F.lit(" > t0 "), F.col("t0_date").cast("string"),
        ),
    )
    bad = (
        studies.join(programs, "program_id")
        .select("program_id", "study_no", detail.alias("violation_detail"))
        .filter("violation_detail is not null")
        .groupBy("program_id")
        .agg(F.min(F.struct("study_no", "violation_detail"))["violation_detail"].alias("pub_detail"))
    )
    t0_detail = F.when(F.col("t0_date").isNull(), "t0_date not set")
    checks = F.array(
        F.struct(F.lit("t0_defined").alias("check_type"), t0_detail.alias("violation_detail")),
        F.struct(
            F.lit("publication_after_t0").alias("check_type"), F.col("pub_detail").alias("violation_detail")
        ),
    )
    return (
        programs.join(bad, "program_id", "left")
        .select("program_id", F.explode(checks).alias("c"))
        .select(
            "program_id",
            "c.check_type",
            F.col("c.violation_detail").isNull().alias("passed"),
            "c.violation_detail",
        )
    )


def temporal_split_check(programs: DataFrame, split: str, train_max: int, test_min: int) -> DataFrame:
    """Programs whose t0 year contradicts their split. `programs`: program_id, t0_date, `split`."""
    year, kind = F.year("t0_date"), F.col(split)
    detail = (
        F.when(year.isNull(), "missing t0 year")
        .when((kind == "train") & (year > train_max), F.concat(
            F.lit("train split but t0 year "), year.cast("string"), F.lit(f" > {train_max}")))
        .when((kind == "test") & (year < test_min), F.concat(
            F.lit("test split but t0 year "), year.cast("string"), F.lit(f" < {test_min}")))
    )
    return programs.select(
        "program_id",
        F.lit("temporal_split_integrity").alias("check_type"),
        detail.isNull().alias("passed"),
        detail.alias("violation_detail"),
    )


def constraint_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each CHECK rule, in one pass. A rule that evaluates to null holds, as in SQL."""
    sums = df.agg(*[F.count(F.when(~cond, 1)).alias(name) for name, cond in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_bad")) for n in rules])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """UNIQUE: number of keys that occur more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return dup.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """FOREIGN KEY: child rows whose non-null key has no parent."""
    counted = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    lost = counted.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def volume_audit(counts: DataFrame) -> DataFrame:
    """Pass/partial/fail per data volume check, from one row of counts."""

    def grade(value: Column, full: Column | float, part: Column | float) -> Column:
        return F.when(value >= full, "pass").when(value >= part, "partial").otherwise("fail")

    n, es, mf = F.col("n_catalysts"), F.col("n_event_study"), F.col("n_market_features")
    wf, tr = F.col("n_ledger"), F.col("n_trades")
    checks = {
        "catalysts": (F.when(n >= 100, "pass").otherwise("fail"), n),
        "event_study": (grade(es, n * 0.60, n * 0.50), es),
        "price_coverage": (grade(es, n * 0.95, n * 0.75), es),
        "market_features": (F.when(mf >= es, "pass").otherwise("partial"), mf),
        "oos_ledger": (grade(wf, F.lit(20), F.lit(1)), wf),
        "oos_trades": (grade(tr, F.lit(20), F.lit(5)), tr),
    }
    rows = F.array(*[
        F.struct(F.lit(k).alias("check"), s.alias("status"), v.alias("value")) for k, (s, v) in checks.items()
    ])
    return counts.select(F.explode(rows).alias("c")).select("c.*")
