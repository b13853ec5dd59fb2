"""The modelling frame: events with their CAR and every feature family, each nulled where it was not known at the cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import cutoffs, features
from eventide.session import spread

#: Observation date of each family, by its flag.
FAMILIES = {
    "market_features_point_in_time": "market_feature_as_of", "company_features_point_in_time": "exposure_as_of",
    "trial_features_point_in_time": "trial_source_observed_at",
}


def modelling_rows(
    events: DataFrame, car: DataFrame, market: DataFrame, trial: DataFrame, preclinical: DataFrame, labelled_only: bool = True, car_join: str = "left",
) -> DataFrame:
    """One row per event with market, trial and preclinical features; a family unproven at the cutoff is nulled.

    events: catalyst_id, ticker, drug_name, indication, announcement_date, clinical_success, cutoff. The others hold one row per
    catalyst_id: car (car), market (as_of_date and MARKET), trial (trial_source_observed_at and CLINICAL), preclinical (PRECLINICAL,
    already as of the cutoff). They are joined on the one key, dealt out by the number of events, so that the rows a task sorts do
    not grow with the tables.
    """
    df = spread(events.select(
        "catalyst_id", "ticker", "drug_name", "indication", "announcement_date", "clinical_success",
        F.col("cutoff").alias("feature_cutoff_date"), F.year("announcement_date").alias("catalyst_year"),
    ), "catalyst_id", rows=events.count())
    df = df.join(car.select("catalyst_id", F.col("car").alias("realized_car")), "catalyst_id", car_join)
    if labelled_only:
        df = df.filter(cutoffs.labelled_only("clinical_success", "realized_car"))
    df = df.join(market.withColumnRenamed("as_of_date", "market_feature_as_of"), "catalyst_id", "left")
    df = df.join(trial, "catalyst_id", "left").join(preclinical, "catalyst_id", "left")
    for flag, columns in (("market_features_point_in_time", features.MARKET), ("trial_features_point_in_time", features.CLINICAL)):
        df = cutoffs.sanitize_family(df, columns, FAMILIES[flag], "feature_cutoff_date", flag)
    both = F.col("market_features_point_in_time") & F.col("trial_features_point_in_time")
    return df.withColumn("structured_features_point_in_time", both)


def with_exposure(df: DataFrame, exposure: DataFrame) -> DataFrame:
    """Exposure (catalyst_id, exposure_as_of and COMPANY) as a third family, the latest date any safe family was observed,
    and the outcome category."""
    df = df.join(exposure, "catalyst_id", "left")
    flag = "company_features_point_in_time"
    df = cutoffs.sanitize_family(df, features.COMPANY, FAMILIES[flag], "feature_cutoff_date", flag)
    return df.withColumns({
        "feature_as_of_date": cutoffs.latest_safe_date(FAMILIES),
        "outcome_category": F.when(F.col("clinical_success") == 0, "EFFICACY_FAILURE").otherwise("SUCCESS"),
    })
