"""Explicit schemas of landed files and stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


BARS = (
    "ticker string, date date, open double, high double, low double, close double, adj_close double, "
    "volume double, provider string"
)
ARCHIVE = (
    "symbol string, date string, open double, high double, low double, close double, volume double, adj_close double"
)
POLYGON = "status string, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
EXTERNAL_EVENTS = (
    "ticker string, drug string, disease string, stage string, event_date string, event_desc string"
)
BASE_RATES = (
    "source string, phase string, indication_group string, modality string, biomarker_enriched boolean, "
    "success_rate double, n_programs int, effective_year_range string, notes string"
)
COMPANY_FACTS = (
    "cik bigint, facts map<string, map<string, struct<units: map<string, array<struct<val: double, end: string, "
    "filed: string, form: string>>>>>>"
)
TICKER_CIK = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
DATE_STRUCT = "struct<date: string>"
STUDY = f"""protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string>,
  statusModule: struct<overallStatus: string, whyStopped: string, startDateStruct: {DATE_STRUCT},
    primaryCompletionDateStruct: {DATE_STRUCT}, completionDateStruct: {DATE_STRUCT},
    studyFirstPostDateStruct: {DATE_STRUCT}, resultsFirstPostDateStruct: {DATE_STRUCT}>,
  designModule: struct<phases: array<string>, enrollmentInfo: struct<count: int>,
    designInfo: struct<allocation: string, maskingInfo: struct<masking: string>>>,
  conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<name: string>>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>,
  outcomesModule: struct<primaryOutcomes: array<struct<measure: string>>>>,
resultsSection struct<outcomeMeasuresModule: struct<outcomeMeasures: array<struct<type: string,
  analyses: array<struct<pValue: string>>>>>>"""
ARTICLE = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string,
  Abstract: struct<AbstractText: array<string>>,
  Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"""
