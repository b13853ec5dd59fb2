"""Landed trial, publication, filing and event documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import schemas
from eventide.functions import scalars as sc


def read_studies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Trial registry payloads → one flat row per study."""
    raw = spark.read.schema(schemas.STUDY).json(path, multiLine=multi_line)
    return parse_studies(raw)


def primary_met(measures: Column) -> Column:
    """Whether the last readable p-value of the primary outcomes is below 0.05; null when none is."""
    primary = F.filter(measures, lambda m: m["type"] == "PRIMARY")
    texts = F.flatten(F.transform(primary, lambda m: F.coalesce(m["analyses"], F.array().cast("array<struct<pValue:string>>"))))
    values = F.transform(texts, lambda a: F.regexp_replace(a["pValue"], "[<>]", "").try_cast("double"))
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1) < 0.05)


def parse_studies(raw: DataFrame) -> DataFrame:
    p = "protocolSection."
    status = p + "statusModule."
    date = lambda name: sc.partial_date(F.col(f"{status}{name}.date"))
    phases = F.col(p + "designModule.phases")
    names = F.transform(F.col(p + "armsInterventionsModule.interventions"), lambda i: F.coalesce(i["name"], F.lit("")))
    outcomes = F.transform(F.col(p + "outcomesModule.primaryOutcomes"), lambda o: F.coalesce(o["measure"], F.lit("")))
    empty = F.array().cast("array<string>")
    return raw.select(
        F.col(p + "identificationModule.nctId").alias("nct_id"),
        F.col(p + "identificationModule.briefTitle").alias("brief_title"),
        F.coalesce(F.get(phases, 0), F.lit("UNKNOWN")).alias("phase"),
        F.coalesce(F.col(p + "conditionsModule.conditions"), empty).alias("conditions"),
        F.coalesce(names, empty).alias("interventions"),
        F.col(p + "sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        F.coalesce(F.col(status + "overallStatus"), F.lit("")).alias("overall_status"),
        F.col(status + "whyStopped").alias("why_stopped"),
        date("startDateStruct").alias("start_date"),
        date("primaryCompletionDateStruct").alias("primary_completion_date"),
        date("completionDateStruct").alias("study_completion_date"),
        date("studyFirstPostDateStruct").alias("first_posted_date"),
        date("resultsFirstPostDateStruct").alias("results_first_posted_date"),
        F.col(p + "designModule.enrollmentInfo.count").alias("enrollment"),
        F.col(p + "designModule.designInfo.allocation").alias("allocation"),
        F.col(p + "designModule.designInfo.maskingInfo.masking").alias("masking"),
        F.coalesce(outcomes, empty).alias("primary_outcomes"),
        primary_met(F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")).alias("primary_met"),
    )


def _inner_text(c: Column) -> Column:
    """Text of mixed content: nested tags removed, the five XML entities resolved."""
    plain = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article XML → pmid, title, abstract (parts joined by a space), publication date, doi."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schemas.ARTICLE).load(path)
    art = "MedlineCitation.Article."
    d = F.col(art + "Journal.JournalIssue.PubDate")
    month = F.coalesce(d["Month"], F.lit("1"))
    month = F.when(month.rlike("^[0-9]+$") | F.lower(F.substring(month, 1, 3)).isin(*sc.MONTHS), month).otherwise("1")
    text = F.concat_ws("-", d["Year"], month, F.coalesce(d["Day"], F.lit("1")))
    dois = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi")
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        _inner_text(F.col(art + "ArticleTitle")).alias("title"),
        F.array_join(F.transform(F.col(art + "Abstract.AbstractText"), _inner_text), " ").alias("abstract"),
        F.when(d["Year"].isNotNull(), sc.partial_date(text)).alias("publication_date"),
        F.when(F.size(dois) > 0, F.element_at(dois, -1)["_VALUE"]).alias("doi"),
    )


def read_company_facts(spark: SparkSession, path: str, taxonomy: str = "us-gaap") -> DataFrame:
    """Filing facts, one row per (cik, tag, unit, entry), `pos` being the entry's place in its list."""
    raw = spark.read.schema(schemas.COMPANY_FACTS).json(path)
    tags = raw.select("cik", F.explode(F.col("facts").getItem(taxonomy)).alias("tag", "t"))
    units = tags.select("cik", "tag", F.explode("t.units").alias("unit", "entries"))
    rows = units.select("cik", "tag", "unit", F.posexplode("entries").alias("pos", "e"))
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    return rows.select("cik", "tag", "unit", "pos", F.col("e.val").alias("val"), day("e.end").alias("end"),
                       day("e.filed").alias("filed"), F.col("e.form").alias("form"))


def read_ticker_cik(spark: SparkSession, path: str) -> DataFrame:
    """ticker → cik; the last entry of a repeated ticker wins."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.TICKER_CIK).alias("m"))
    rows = doc.select(F.posexplode(F.map_values("m")).alias("pos", "e"))
    return rows.groupBy(F.upper("e.ticker").alias("ticker")).agg(F.max_by("e.cik_str", "pos").alias("cik"))


def read_external_events(spark: SparkSession, path: str) -> DataFrame:
    """Event sheet exported as CSV: six columns, mixed date forms, trimmed stage."""
    raw = spark.read.schema(schemas.EXTERNAL_EVENTS).csv(path, header=True)
    return raw.select(
        "ticker", "drug", "disease", F.trim("stage").alias("stage_normalized"),
        sc.mixed_date(F.col("event_date")).alias("event_date"), "event_desc")


def clinical_phase(events: DataFrame) -> DataFrame:
    return events.filter(F.col("stage_normalized").rlike(r"(?i)Phase\s*[23]"))


def event_manifest(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


def read_base_rates(spark: SparkSession, path: str) -> DataFrame:
    """Base-rate table with its row order kept (the first matching row wins in lookups)."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return spark.read.schema(schemas.BASE_RATES).csv(path, header=True).withColumn("row_pos", at)


def read_delisted(spark: SparkSession, path: str, schema: str, order: str, limit: int | None = None) -> DataFrame:
    """A delisting feed; with a `limit`, its first rows by `order`."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated lookup (overrides, ticker history, delistings, tiers, adjudications) as JSON lines."""
    return spark.read.schema(schema).json(path)
