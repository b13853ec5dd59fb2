"""Event-level features: market, trial design, exposure, derived flags and feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.asof import backward_state
from eventide.operators.ordered import quantiles
from eventide.operators.series import trailing_features

# Columns of the feature families.
MARKET = (
    "return_1d",
    "return_5d",
    "return_20d",
    "return_60d",
    "return_120d",
    "abnormal_return_20d_xbi",
    "abnormal_return_60d_xbi",
    "distance_from_52w_high",
    "realized_vol_20d",
    "volume_ratio_20d",
    "pre_catalyst_runup_60d",
)
COMPANY = ("company_dependency", "is_lead_asset", "is_single_asset_company")
CLINICAL = (
    "phase_numeric",
    "log_enrollment",
    "is_randomized",
    "is_blinded",
    "is_combination",
    "endpoint_os",
    "endpoint_pfs",
    "endpoint_orr",
    "wong_pos_rate",
    "n_prior_same_drug",
    "prior_success_rate_same_drug",
)
PRECLINICAL = (
    "preclinical_evidence_found",
    "n_preclinical_publications",
    "n_animal_studies",
    "median_effect_size",
)
# Named feature sets; an entry starting with @ includes another set.
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "market_only": MARKET,
    "company_only": COMPANY,
    "clinical_only": CLINICAL,
    "preclinical_only": PRECLINICAL,
    "trial_only": ("@clinical_only",),
    "human_evidence_only": (
        "wong_pos_rate",
        "n_prior_same_drug",
        "prior_success_rate_same_drug",
        "log_enrollment",
    ),
    "market_plus_company": ("@market_only", "@company_only"),
    "market_plus_trial": ("@market_only", "@clinical_only"),
    "market_plus_preclinical": ("@market_only", "@preclinical_only"),
    "market_plus_trial_plus_preclinical": ("@market_only", "@clinical_only", "@preclinical_only"),
    "clinical_plus_market": ("@clinical_only", "@market_only"),
    "clinical_plus_human": ("@clinical_only", "@human_evidence_only"),
    "everything_no_preclinical": ("@market_only", "@company_only", "@clinical_only"),
    "everything": ("@everything_no_preclinical", "@preclinical_only"),
}


def resolve_features(name: str, sets: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Columns of a named set, included sets expanded in place, first occurrence kept."""
    sets = sets or FEATURE_SETS
    out: list[str] = []
    for item in sets[name]:
        out.extend(resolve_features(item[1:], sets) if item.startswith("@") else [item])
    return list(dict.fromkeys(out))


def split_features(name: str) -> tuple[list[str], list[str]]:
    """(columns for the success model, columns for the return models): the latter see market data only."""
    return resolve_features(name), list(MARKET)


def with_feature_set(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Keep `keep` plus the set's columns, adding the missing ones as null."""
    cols = resolve_features(name)
    missing = {c: F.lit(None).cast("double") for c in cols if c not in df.columns}
    return df.withColumns(missing).select(*keep, *cols)


def market_features(events: DataFrame, bars: DataFrame, bench_wide: DataFrame) -> DataFrame:
    """Trailing features from sessions strictly before each event's cutoff; events lacking 30 such
    sessions drop out. `events`: catalyst_id, ticker, cutoff, …"""
    feats = trailing_features(bars, bench_wide)
    payload = [F.col("date").alias("as_of_date"), "price_at_cutoff", *MARKET]
    named = feats.select("ticker", "date", *payload)
    joined = backward_state(
        events, named, ["ticker"], "cutoff", "date", F.col("date"),
        ["as_of_date", "price_at_cutoff", *MARKET], "f", strict=True,
    )
    return joined.filter(F.col("f").isNotNull()).select(*events.columns, "f.*")


def prior_same_drug(events: DataFrame) -> DataFrame:
    """Number and success rate of labelled events of the same drug on strictly earlier days.

    Counts are collapsed to one row per (drug, day) before the running sum. Undated events get (0, null).
    """
    daily = (
        events.filter(F.col("announcement_date").isNotNull())
        .groupBy("drug_name", "announcement_date")
        .agg(F.count("clinical_success").alias("_n"), F.sum("clinical_success").alias("_s"))
    )
    w = (
        Window.partitionBy("drug_name")
        .orderBy("announcement_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.coalesce(F.sum("_n").over(w), F.lit(0))
    prior = daily.select(
        "drug_name",
        "announcement_date",
        n.alias("n_prior_same_drug"),
        F.when(n > 0, F.coalesce(F.sum("_s").over(w), F.lit(0)) / n).alias("prior_success_rate_same_drug"),
    )
    joined = events.join(prior, ["drug_name", "announcement_date"], "left")
    return joined.withColumn("n_prior_same_drug", F.coalesce("n_prior_same_drug", F.lit(0).cast("long")))


def sponsor_exposure(events: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier and dependency score by ticker list; unlisted tickers are small caps with a lead asset.

    Rows already sourced from filings (`data_source = 'sec_edgar'`) keep their values.
    """
    named = tiers.select(F.upper("ticker").alias("_t"), F.col("tier").alias("_tier"))
    joined = events.join(named, F.upper("ticker") == F.col("_t"), "left")
    tier = F.coalesce("_tier", F.lit("small_cap"))
    score = F.when(tier == "large_pharma", 0.20).when(tier == "mid_cap", 0.55).otherwise(0.90)
    small = (tier == "small_cap").cast("int")
    sec = F.coalesce(F.col("data_source") == "sec_edgar", F.lit(False))
    return joined.select(
        *[c for c in events.columns if c not in ("company_dependency", "data_source")],
        F.when(sec, F.col("company_dependency")).otherwise(score).alias("company_dependency"),
        F.when(sec, F.col("data_source")).otherwise(F.concat(F.lit("heuristic_"), tier)).alias("data_source"),
        F.when(~sec, small).alias("is_lead_asset"),
        F.when(~sec, small).alias("is_single_asset_company"),
    )


def risk_flags(df: DataFrame) -> DataFrame:
    """0/1 flags derived from outcome, CAR, exposure, momentum, volatility and phase.

    A missing dependency reads as 0.9. Volatility is compared with the exact median of the frame.
    """
    median = quantiles(df, [], "realized_vol_20d", {"m": 0.5}).select("m").scalar()
    dep = F.coalesce("company_dependency", F.lit(0.9))
    phase = F.coalesce("phase_numeric", F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns(
        {
            "clinical_failure": flag(F.col("clinical_success") == 0),
            "efficacy_safety_failure": flag(
                F.col("outcome_category").isin("EFFICACY_FAILURE", "SAFETY_FAILURE")
            ),
            "major_negative_event": flag(F.col("realized_car") <= -0.20),
            "catastrophic_drop": flag(F.col("realized_car") <= -0.40),
            "company_dependency": dep,
            "is_small_cap": flag(dep >= 0.85),
            "is_large_cap": flag(dep <= 0.25),
            "high_momentum": flag(F.coalesce("pre_catalyst_runup_60d", F.lit(0.0)) > 0.15),
            "high_volatility": flag(F.coalesce("realized_vol_20d", F.lit(0.0)) > median),
            "high_dependency": flag(dep >= 0.80),
            "phase_3": flag(phase >= 3),
            "phase_2": flag((phase >= 2) & (phase < 3)),
        }
    )


def exposure_adjusted(df: DataFrame, exposure: DataFrame, key: str = "catalyst_id") -> DataFrame:
    """Left join of the exposure; expected CAR scaled by dependency, 0.9 where unknown."""
    joined = df.join(exposure.select(key, F.col("company_dependency").alias("_dep")), key, "left")
    dep = F.coalesce("_dep", F.lit(0.9))
    return joined.withColumns(
        {"company_dependency": dep, "expected_car_adj": F.col("expected_car") * dep}
    ).drop("_dep")


def enrich_missing(df: DataFrame, frame: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Bring the wanted columns `df` lacks from `frame` by key."""
    absent = [c for c in wanted if c not in df.columns and c in frame.columns]
    return df.join(frame.select(key, *absent), key, "left") if absent else df


def first_or_none(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cols: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as a combinable aggregate."""
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    picked = F.min_by(F.struct(*cols), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(o)]))
    return df.groupBy(*keys).agg(picked.alias("_f")).select(*keys, "_f.*")
