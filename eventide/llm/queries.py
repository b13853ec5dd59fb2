"""Registered queries of the package and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import (
    decontamination, embedding_dedup, filter_audit, html_text, language, licenses, ngram_join, packing, personal_data, quality, toxicity,
    url_filter, whitening,
)
from eventide.llm.tables import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.train(docs))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages, url_filter.page_outcomes(pages, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.personal_data(table(spark, sf_dir, "documents")))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_toxicity, op3_benchmark_decontamination, op4_packing, op5_license_scan, op6_language_id, op7_url_filter,
        op8_html_extraction, op9_ngram_jaccard_join, op10_quality_classifier, op11_pii,
        op12_filter_interaction_audit, op13_embedding_whitening,
    )
}

_RULE_FITS = {
    "net/": "(host = 'net' or ends_with(host, '.net')) and starts_with(path, '/')",
    "org/fr/": "(host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/')",
    "example.net/en/": "(host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/')",
    "example.com/de/": "(host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/')",
}

_SHARE = """greatest(0.001, least(0.999, coalesce(
  (sum(n * pow(good / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 0), 0.001)))"""

OP7_SQL = f"""
with parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), marks as (
  select doc_id, min(case when quality = 1 and coalesce(toxic, 0) <> 1 then 1 else 0 end) as good
  from labels where quality is not null group by doc_id
), outcomes as (
  select host, good from (select host, regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) as number from parts) p
  join marks on p.number <> '' and try_cast(p.number as bigint) = marks.doc_id
), hosts as (
  select host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain,
         string_split(host, '.')[-1] as suffix, count(*)::double as n, sum(good)::double as good
  from outcomes group by host
), domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by all),
overall as (select (sum(good) + 1) / (sum(n) + 2) as prior from hosts),
s as (select suffix, n, good, prior from suffixes, overall),
sk as (select {_SHARE} as rho from s),
sm as (select suffix, (good + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) as mean from s, sk),
d as (select domain, domains.n, domains.good, sm.mean as prior from domains join sm using (suffix)),
dk as (select {_SHARE} as rho from d),
dm as (select domain, (good + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) as mean from d, dk),
h as (select host, hosts.n, hosts.good, dm.mean as prior from hosts join dm using (domain)),
hk as (select {_SHARE} as rho from h),
hm as (select host, (good + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) as mean, n + (1 - rho) / rho as weight from h, hk),
ruled as (
  select *, case when {_RULE_FITS["example.net/en/"]} then 'example.net/en/' when {_RULE_FITS["example.com/de/"]} then 'example.com/de/'
                 when {_RULE_FITS["org/fr/"]} then 'org/fr/' when {_RULE_FITS["net/"]} then 'net/' end as rule from parts
), judged as (
  select ruled.*, coalesce(hm.mean, dm.mean, sm.mean, overall.prior) as m, coalesce(hm.weight, (1 - rho) / rho) as w
  from ruled left join hm on ruled.host = hm.host
  left join dm on dm.domain = array_to_string(list_slice(string_split(ruled.host, '.'), -2, -1), '.')
  left join sm on sm.suffix = string_split(ruled.host, '.')[-1], overall, hk
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when m - 1.645 * sqrt(m * (1 - m) / (w + 1)) < 0.65 then 'block' else 'allow' end as verdict
from judged
"""

OP12_SQL = r"""
with recursive docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from docs),
masks as (
  select doc_id, part,
         case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
         + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > first_id then 16 else 0 end as mask
  from split
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), counts as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from masks left join marks on masks.doc_id = marks.doc_id group by part, mask
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select '' as o union all select o || x from orders, letters where instr(o, x) = 0),
steps as (
  select o as filter_order, step, instr('ABCDE', substr(o, step, 1)) as filter, 1 << (instr('ABCDE', substr(o, step, 1)) - 1) as f,
         (select coalesce(sum(1 << (instr('ABCDE', substr(o, i, 1)) - 1)), 0)::int from range(1, 5) r(i) where i < step) as p
  from orders, range(1, 6) s(step) where length(o) = 5
), figures as (
  select part, filter_order, step::int as step, filter,
         sum(case when mask & (p | f) = 0 then n else 0 end)::bigint as kept,
         sum(case when mask & f <> 0 and mask & p = 0 then n else 0 end)::bigint as removed,
         sum(case when mask & f <> 0 and mask & p <> 0 then n else 0 end)::bigint as redundant,
         sum(case when mask = f then n else 0 end)::bigint as unique_fails,
         sum(case when mask & f <> 0 and mask & p = 0 then good else 0 end)::bigint as good_lost,
         sum(case when mask & f <> 0 and mask & p = 0 then toxic else 0 end)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, filter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, filter)::bigint as shapley
from figures
"""

ORACLE = {"op7_url_filter": OP7_SQL, "op12_filter_interaction_audit": OP12_SQL}
