"""Table writes: caches, refreshes, snapshots, frozen baselines, exports and bundle fan-out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_bar_cache(bars: DataFrame, path: str) -> None:
    """provider=…/ticker=… folders for a modest number of tickers. Rows are placed by folder before
    writing, so each folder gets one file instead of one per task."""
    bars.repartition("provider", "ticker").write.mode("overwrite").partitionBy("provider", "ticker").parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Layout for many tickers: provider and year folders, rows ranged by (ticker, date) so that file
    statistics prune by ticker and date."""
    (
        bars.withColumn("year", F.year("date"))
        .repartitionByRange("provider", "year", "ticker", "date")
        .sortWithinPartitions("provider", "year", "ticker", "date")
        .write.mode("overwrite").partitionBy("provider", "year").parquet(path)
    )


def refresh(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").parquet(path)


def append_snapshots(df: DataFrame, path: str) -> None:
    """Add immutable observations (key, observed_at, payload)."""
    df.write.mode("append").parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def freeze(tables: dict[str, DataFrame | None], root: str, version: str) -> DataFrame:
    """Copy named result tables under version=<id>; the manifest tells copied from missing ones.

    Copies are counted from what was written.
    """
    spark = next(t for t in tables.values() if t is not None).sparkSession
    rows = []
    for name, df in tables.items():
        target = os.path.join(root, f"version={version}", name)
        if df is None:
            rows.append((name, "missing", None, version))
            continue
        refresh(df, target)
        rows.append((name, "copied", spark.read.parquet(target).count(), version))
    return spark.createDataFrame(rows, "name string, status string, n_rows bigint, version string")


def key_of(*cols: str):
    """Surrogate key from the natural key: reruns give the same id."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def bundle_tables(bundles: DataFrame, studies: DataFrame) -> dict[str, DataFrame]:
    """Fan curated records out to their normalised tables.

    `bundles`: program_id, ticker, company_name, drug_name, indication, t0_date, nct_id, clinical_success,
    event_date. `studies`, one row each: program_id, pmid, species, effect_size. Studies of one publication are told
    apart by their number in the order of species and effect.
    """
    order = Window.partitionBy("program_id", "pmid").orderBy("species", "effect_size")
    studies = studies.withColumn("study_no", F.row_number().over(order))
    company = bundles.groupBy(F.upper("ticker").alias("ticker")).agg(F.min_by("company_name", "program_id").alias("name"))
    source = studies.select("pmid").distinct()
    counts = studies.groupBy("program_id").agg(F.count(F.lit(1)).alias("_n"))
    return {
        "companies": company.select(key_of("ticker").alias("company_id"), "ticker", "name"),
        "programs": bundles.withColumn("ticker", F.upper("ticker")).select(
            "program_id", key_of("ticker").alias("company_id"), "drug_name", "indication", F.col("nct_id").alias("primary_nct_id")),
        "program_t0": bundles.select("program_id", "t0_date"),
        "clinical_trials": bundles.filter("nct_id is not null").select("nct_id").distinct(),
        "trial_outcomes": bundles.select("program_id", F.lit("PHASE2").alias("outcome_level"), "clinical_success"),
        "source_records": source.select(key_of("pmid").alias("source_record_id"), F.lit("PUBMED").alias("source_type"), "pmid"),
        "publications": source.select(key_of("pmid").alias("publication_id"), key_of("pmid").alias("source_record_id"), "pmid"),
        "publication_program_links": studies.select("program_id", "pmid").distinct().select(
            key_of("program_id", "pmid").alias("link_id"), "program_id", key_of("pmid").alias("publication_id")),
        "animal_studies": studies.select(
            key_of("program_id", "pmid", "study_no").alias("study_id"), "program_id", key_of("pmid").alias("publication_id"), "species"),
        "animal_study_features": studies.select(
            key_of("program_id", "pmid", "study_no").alias("study_id"), "effect_size"),
        "program_preclinical_features": bundles.join(counts, "program_id", "left").select(
            "program_id", F.coalesce("_n", F.lit(0).cast("long")).alias("n_animal_studies")),
        "program_financial_events": bundles.filter("event_date is not null").select(
            key_of("program_id", "event_date").alias("event_id"), "program_id", "event_date"),
    }
