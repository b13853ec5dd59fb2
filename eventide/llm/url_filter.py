"""URL rules and host reputation by empirical Bayes.

Method: labelled page outcomes are counted per host, registered domain and suffix. Each level's rate is a
beta-binomial posterior whose prior mean is its parent's posterior mean (host <- registered domain <-
suffix <- all) and whose prior strength is estimated from all units of the level by the method of
moments. A page is blocked when the lower posterior bound of its host's good rate is below a threshold.
Only DataFrame expressions are used. Counts are combined before any shuffle, so a host with a third of all
pages costs one row per task; the reputation comes back to the pages by an equi-join whose other side has one row per
host, which the engine broadcasts when small and splits when skewed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.tables import written

#: (verdict, host suffix, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        text, verdict = F.when(fits, suffix + prefix).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _with_posterior(units: DataFrame, prior: Column, name: str) -> tuple[DataFrame, Column]:
    """The units with <name>_mean = (good + strength * prior) / (n + strength), and the level's strength.

    Strength by moments over the level's units: with rate r of n outcomes, Q = sum n (r - prior)^2,
    V = sum prior (1 - prior), M = sum n prior (1 - prior), the share of variance between units is
    rho = (Q - V) / (M - V), held within [0.001, 0.999], and the strength is (1 - rho) / rho.
    """
    spread = prior * (1 - prior)
    total = units.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - prior, 2)).alias("q"),
        F.sum(spread).alias("v"), F.sum(F.col("n") * spread).alias("m"),
    )
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(F.try_divide(F.col("q") - F.col("v"), F.col("m") - F.col("v")), F.lit(0.001))))
    strength = total.select((1 - rho) / rho).scalar()
    return units.withColumn("_strength", strength).withColumn(
        f"{name}_mean", (F.col("good") + F.col("_strength") * prior) / (F.col("n") + F.col("_strength"))
    ).drop("_strength"), strength


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels; an empty host is its own."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lower_bound(mean: Column, weight: Column, z: float = 1.645) -> Column:
    """mean - z * sd of a beta posterior of this mean and weight, 0 at least; null without a mean."""
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))))


@dataclass(frozen=True)
class Reputation:
    """Posterior means per host (with n and good), registered domain and suffix, the overall rate, and the host level's strength.

    A host without an outcome has n = 0: its mean is its domain's, else its suffix's, else the overall one, its weight the strength.
    """

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    overall: Column
    strength: Column


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host with an outcome: n, good, posterior mean and lower bound; see `reputation`."""
    found = reputation(outcomes)
    rows = found.hosts.withColumn("_strength", found.strength)
    return rows.withColumn("bound", lower_bound(F.col("mean"), F.col("n") + F.col("_strength"), z)).drop("_strength")


def reputation(outcomes: DataFrame) -> Reputation:
    """outcomes: (host, good 0/1). The registered domain is the last two labels of the host, the suffix the
    last one; an empty host is its own. Null outcomes or hosts are left out. The prior strengths are scalar subqueries
    over the written table of host counts.
    """
    hosts = outcomes.filter("host is not null and good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = written(hosts, "hosts").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = hosts.agg((F.sum("good") + 1) / (F.sum("n") + 2)).scalar()
    s, _ = _with_posterior(suffixes.withColumn("all_mean", overall), F.col("all_mean"), "suffix")
    s = s.select("suffix", "suffix_mean")
    d, _ = _with_posterior(domains.join(s, "suffix"), F.col("suffix_mean"), "domain")
    d = d.select("domain", "domain_mean")
    h, strength = _with_posterior(hosts.join(d, "domain"), F.col("domain_mean"), "host")
    h = h.select("host", "domain", "suffix", "n", "good", F.col("host_mean").alias("mean"))
    return Reputation(h, d, s, overall, strength)


def url_verdicts(pages: DataFrame, outcomes: DataFrame, threshold: float = 0.65, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    A rule decides first; else the lower bound of the host's posterior (block below the threshold). A host without an outcome, an
    empty one included, takes its domain's posterior, else its suffix's, else the overall one, at the host level's strength; without
    any outcome at all pages are allowed. Null urls give empty host and path. Repeated rows are kept; other columns are left behind.
    """
    parts = pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes)
    # one row per host of the pages is judged, then joined back: the levels are looked up once per host, not per page
    hosts = parts.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = hosts.join(known.hosts.select("host", "n", "mean"), "host", "left").join(known.domains, "domain", "left").join(known.suffixes, "suffix", "left")
    hosts = hosts.withColumns({"_overall": known.overall, "_strength": known.strength})
    mean, weight = F.coalesce("mean", "domain_mean", "suffix_mean", "_overall"), F.coalesce("n", F.lit(0)) + F.col("_strength")
    hosts = hosts.select("host", lower_bound(mean, weight).alias("bound"))
    judged = F.when(F.col("bound") < threshold, "block").otherwise("allow")
    return (
        parts.withColumns({"rule": text, "said": verdict})
        .join(hosts, "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"))
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of labelled pages: the number that ends a page's path names its document; good where the
    document's quality label is 1 and its toxic label is not 1."""
    url = F.coalesce("url", F.lit(""))
    seen = pages.select(host_of(url).alias("host"), F.regexp_extract(path_of(url), "/([0-9]{1,18})(?:\\.html)?/?$", 1).alias("number"))
    seen = seen.filter("number <> ''").select("host", F.col("number").cast("long").alias("label_doc"))
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("label_doc")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1).otherwise(0)).alias("good")
    )
    return seen.join(marks, "label_doc").select("host", "good")
