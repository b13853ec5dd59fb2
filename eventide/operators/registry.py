"""Registry maintenance: upserts, overrides, date inference, migration, curation and cohort loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators.cutoffs import trading_cutoffs

# Source tags, defaults and windows of the registry.
T0_PROXY_DAYS = 540
SRC_RESULTS, SRC_OUTCOME, SRC_T0 = "INFERRED_CTGOV_RESULTS", "INFERRED_OUTCOME_DATE", "INFERRED_T0_PLUS_18MO"
SRC_LEGACY, SRC_PRESS = "LEGACY_UNTAGGED", "PRESS_RELEASE"
T0_YEARS = (2010, 2020)
DEFAULT_START = "2000-01-01"
READOUT = r"(?i)top.?line|primary endpoint|did not meet|met primary|phase [23]|readout|trial data"
SAFETY_WORDS = ("safety", "toxic", "adverse", "death")
EFFICACY_WORDS = ("efficacy", "futility", "lack of", "failed")
COMMERCIAL_WORDS = ("business", "strategic", "sponsor", "commercial")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order, as a combinable aggregate (no sort of the whole key)."""
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(o)]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append rows whose key is not present yet; the first new row per key wins."""
    fresh = dedupe_first(new, keys, order).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """New values win for matching keys; columns in `keep_old_if_null` keep the old value when the new
    one is null. Both sides hold one row per key."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    joined = old.join(n, list(keys), "full_outer")
    hit = F.col("_new").isNotNull()
    out = [
        (F.coalesce(f"_n_{c}", c) if c in keep_old_if_null else F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c)
        for c in values
    ]
    return joined.select(*keys, *out)


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-row replacement by key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def latest_snapshot(snapshots: DataFrame, key: str, observed: str, payload: str) -> DataFrame:
    """The last observed payload per key; of payloads observed at the same time, the greatest."""
    return snapshots.groupBy(key).agg(
        F.max_by(payload, F.struct(observed, payload)).alias(payload), F.max(observed).alias(observed), F.count(F.lit(1)).alias("n_snapshots")
    )


def infer_dates(df: DataFrame) -> DataFrame:
    """Fill missing announcement dates from results posted, outcome date or t0 plus 540 days; upgrade
    weak t0 proxies once results are posted; tag dated rows that have no source.

    Needs announcement_date, announcement_source, results_posted, outcome_date, t0_date.
    """
    missing = F.col("announcement_date").isNull()
    inferred = F.coalesce("results_posted", "outcome_date", F.date_add("t0_date", T0_PROXY_DAYS))
    source = (
        F.when(F.col("results_posted").isNotNull(), SRC_RESULTS)
        .when(F.col("outcome_date").isNotNull(), SRC_OUTCOME)
        .when(F.col("t0_date").isNotNull(), SRC_T0)
    )
    filled = df.withColumns({
        "_date": F.when(missing, inferred).otherwise(F.col("announcement_date")),
        "_src": F.when(missing, F.coalesce(source, F.col("announcement_source"))).otherwise(F.col("announcement_source")),
    })
    upgrade = (F.col("_src") == SRC_T0) & F.col("results_posted").isNotNull()
    final_src = F.when(upgrade, SRC_RESULTS).when(
        F.col("_date").isNotNull() & F.col("_src").isNull(), SRC_LEGACY).otherwise(F.col("_src"))
    return filled.withColumns({
        "announcement_date": F.when(upgrade, F.col("results_posted")).otherwise(F.col("_date")),
        "announcement_source": final_src,
    }).drop("_date", "_src")


def apply_overrides(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated date, timing, source and ticker win; cutoffs are derived again with HIGH confidence.

    `overrides`: catalyst_id, ticker, announcement_date, announcement_timing, announcement_source.
    """
    o = overrides.select("catalyst_id", *[F.col(c).alias(f"_o_{c}") for c in overrides.columns if c != "catalyst_id"])
    joined = events.join(o, "catalyst_id", "left")
    hit = F.col("_o_announcement_date").isNotNull()
    timing = F.when(hit, F.coalesce("_o_announcement_timing", F.lit("UNKNOWN"))).otherwise(F.col("timing"))
    merged = joined.withColumns({
        "announcement_date": F.when(hit, F.col("_o_announcement_date")).otherwise(F.col("announcement_date")),
        "timing": timing,
        "announcement_source": F.when(hit, F.coalesce("_o_announcement_source", F.lit(SRC_PRESS))),
        "ticker": F.when(hit & (F.coalesce("_o_ticker", F.lit("")) != ""), F.upper("_o_ticker")).otherwise(F.col("ticker")),
        "_hit": hit,
    })
    cut = trading_cutoffs(merged, "announcement_date", "timing")
    high = F.when(F.col("_hit"), "HIGH").otherwise(F.col("execution_confidence"))
    return cut.withColumn("execution_confidence", high).drop("_hit", *[c for c in o.columns if c != "catalyst_id"])


def override_counts(events: DataFrame, overrides: DataFrame) -> DataFrame:
    known = events.select("catalyst_id", F.lit(1).alias("_k"))
    j = overrides.join(known, "catalyst_id", "left")
    found = F.col("_k").isNotNull()
    return j.agg(
        F.count(F.when(found, 1)).alias("updated"),
        F.count(F.when(found & (F.coalesce("ticker", F.lit("")) != ""), 1)).alias("tickers"),
        F.count(F.when(~found, 1)).alias("missing"),
    )


def sync_delist(history: DataFrame, meta: DataFrame) -> DataFrame:
    """Delisting facts onto matching ticker rows; other rows stay as they are."""
    m = meta.select(F.upper("ticker").alias("_t"), F.col("delisted").alias("_d"), F.col("delist_date").alias("_dd"),
                    F.col("successor_ticker").alias("_s"))
    j = history.join(m, F.upper("ticker") == F.col("_t"), "left")
    hit = F.col("_t").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    return j.select(
        *[c for c in history.columns if c not in ("delisted", "delist_date", "successor_ticker", "map_source")],
        pick(F.coalesce("_d", F.lit(0)), "delisted").alias("delisted"),
        pick(F.col("_dd"), "delist_date").alias("delist_date"),
        pick(F.col("_s"), "successor_ticker").alias("successor_ticker"),
        pick(F.lit("delist_map"), "map_source").alias("map_source"),
    )


def migrate_programs(programs: DataFrame, existing: DataFrame, financial: DataFrame) -> DataFrame:
    """One event per program not registered yet.

    `programs`: program_id, outcome and t0 dates, label flags, n_studies. `financial`: program_id,
    event_type, event_date, pos; the earliest event dates the catalyst.
    """
    todo = programs.join(existing.select("program_id"), "program_id", "left_anti")
    first = dedupe_first(financial.filter("event_date is not null"), ["program_id"], ["event_date", "pos"]).select(
        "program_id", "event_type", "event_date")
    j = todo.join(first, "program_id", "left")
    found = (F.coalesce("n_studies", F.lit(0)) > 0).cast("int")
    base = j.select(
        F.concat(F.lit("CAT-"), F.col("program_id").cast("string")).alias("catalyst_id"),
        "program_id",
        F.coalesce("event_type", F.lit("PHASE2_READOUT")).alias("catalyst_type"),
        F.coalesce("event_date", "outcome_date", "t0_date").alias("announcement_date"),
        F.lit("UNKNOWN").alias("timing"),
        "clinical_success",
        sc.outcome_category(F.col("clinical_success"), F.col("technical_failure"), F.col("safety_failure"),
                            F.col("outcome_unknown")).alias("outcome_category"),
        found.alias("preclinical_evidence_found"),
        found.cast("double").alias("publication_coverage_confidence"),
        F.col("event_date").isNotNull().alias("linked_event"),
    )
    return trading_cutoffs(base, "announcement_date", "timing")


def expand_category(success: Column, technical: Column, safety: Column) -> Column:
    """Cohort-expansion rule: a clean success first, then safety, then anything unsuccessful."""
    yes = lambda c: F.coalesce(c, F.lit(0)) != 0
    return (
        F.when(yes(success) & ~yes(technical) & ~yes(safety), "SUCCESS")
        .when(yes(safety), "SAFETY_FAILURE")
        .when(yes(technical) | ~yes(success), "EFFICACY_FAILURE")
        .otherwise("MIXED")
    )


def outcome_labels(status: Column, why: Column, met: Column) -> dict[str, Column]:
    """Three-valued outcome labels from trial status, stop reason and whether the endpoint was met."""
    st, w = F.upper(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(why, F.lit("")))
    has = lambda words: w.rlike("|".join(words))
    ran = st.isin("COMPLETED", "ACTIVE_NOT_RECRUITING", "RECRUITING", "ENROLLING_BY_INVITATION")
    term, halted = st == "TERMINATED", st.isin("WITHDRAWN", "SUSPENDED")
    safety = term & has(SAFETY_WORDS)
    efficacy = term & ~has(SAFETY_WORDS) & has(EFFICACY_WORDS)
    commercial = term & ~has(SAFETY_WORDS) & ~has(EFFICACY_WORDS) & has(COMMERCIAL_WORDS)
    missed, unclear = ran & (met == F.lit(False)), ran & met.isNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "clinical_success": F.when(ran & met, 1).when(F.coalesce(missed, F.lit(False)) | term | halted, 0),
        "met_primary_endpoint": met.cast("int"),
        "technical_failure": flag(F.coalesce(missed, F.lit(False)) | efficacy),
        "safety_failure": flag(safety),
        "commercial_discontinuation": flag(commercial),
        "outcome_unknown": flag(unclear | halted | (term & ~safety & ~efficacy & ~commercial)),
    }


def adjudicated(inferred: DataFrame, decisions: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Hand-adjudicated labels replace inferred ones where given."""
    d = decisions.select(key, *[F.col(c).alias(f"_d_{c}") for c in cols])
    j = inferred.join(d, key, "left")
    return j.withColumns({c: F.coalesce(f"_d_{c}", c) for c in cols}).drop(*[f"_d_{c}" for c in cols])


def pick_study(results: DataFrame, key: str, prefer: Column) -> DataFrame:
    """Best landed search result per candidate: name match +2, indication prefix +1, preferred phase +1;
    earlier start wins ties, an unknown start counts as 2000-01-01.

    `results`: key, drug, indication_hint, nct_id, phase, title, conditions, interventions, start_date.
    Only phase 2/3 studies whose known start year lies in the cohort window compete.
    """
    phase, title, drug = F.upper(F.coalesce("phase", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))), F.lower("drug")
    year = F.year("start_date")
    ok = (phase.contains("2") | phase.contains("3")) & (year.isNull() | year.between(*T0_YEARS))
    named = title.contains(drug) | F.exists(F.coalesce("interventions", F.array().cast("array<string>")),
                                            lambda i: F.lower(i).contains(drug))
    cond = F.lower(F.array_join("conditions", " "))
    hint = F.lower("indication_hint")
    prefix = cond.contains(F.substring(F.replace(hint, F.lit("_"), F.lit(" ")), 1, 4)) | title.contains(F.substring(hint, 1, 4))
    want = F.upper(prefer)
    liked = (want.contains("3") & phase.contains("3")) | (want.contains("2") & phase.contains("2"))
    score = named.cast("int") * 2 + F.coalesce(prefix, F.lit(False)).cast("int") + F.coalesce(liked, F.lit(False)).cast("int")
    ranked = results.filter(ok).withColumns(
        {"score": score, "_start": F.coalesce("start_date", F.lit(DEFAULT_START).cast("date"))})
    return dedupe_first(ranked, [key], [-F.col("score"), F.col("_start"), F.col("nct_id")]).drop("_start")


def pre_t0_publications(pubs: DataFrame, t0: DataFrame, n: int, key: str = "program_id") -> DataFrame:
    """First `n` publications per program, in landed order, dated on or before t0. n is small, so the
    ranking is cut before its shuffle."""
    dated = pubs.filter(F.col("publication_date").isNotNull()).join(t0, key).filter(
        F.col("publication_date") <= F.col("t0_date"))
    w = Window.partitionBy(key).orderBy("pos")
    return dated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def abstract_cues(text: Column, sentence_chars: int | None = None) -> dict[str, Column]:
    """Species, model, confidence and placeholder features read off an abstract. The word list is
    matched anywhere, also inside words. The source sentence is the whole text, or its first `sentence_chars`."""
    source = F.coalesce(text, F.lit(""))
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = low.rlike("xenograft|mice|mouse|murine|rat")
    return {
        "species": F.when(low.rlike("mouse|mice"), "mouse"),
        "disease_model": F.when(low.contains("xenograft"), "xenograft").when(low.contains("transgenic"), "GEMM"),
        "extraction_confidence": F.when(hit, 0.5).otherwise(0.3),
        "primary_endpoint": F.when(hit, "tumor growth inhibition").otherwise("antitumor activity"),
        "face_validity": hit.cast("int"),
        "source_sentence": source if sentence_chars is None else F.substring(source, 1, sentence_chars),
    }


def literature_query(names: Column, keywords: Sequence[str] = ("mice", "mouse", "xenograft", "murine", "rat"),
                     max_date: Column | None = None) -> Column:
    """Search text: quoted names OR-ed, AND animal keywords, optionally bounded by publication date."""
    quoted = lambda arr: F.array_join(F.transform(arr, lambda n: F.concat(F.lit('"'), n, F.lit('"[Title/Abstract]'))), " OR ")
    query = F.concat(F.lit("("), quoted(names), F.lit(") AND ("), quoted(F.array(*[F.lit(k) for k in keywords])), F.lit(")"))
    if max_date is None:
        return query
    return F.concat(F.lit("("), query, F.lit(") AND (1800/01/01[PDAT] : "), F.date_format(max_date, "yyyy/MM/dd"), F.lit("[PDAT])"))


def effective_specs(specs: DataFrame, inherit: DataFrame) -> DataFrame:
    """Extraction specs per program: its own list, or its parent's when it has none."""
    heirs = inherit.join(specs.select("program_id").distinct(), "program_id", "left_anti")
    parent = specs.withColumnRenamed("program_id", "inherit_from")
    return specs.unionByName(heirs.join(parent, "inherit_from").select(*specs.columns))


def effective_rejects(rejects: DataFrame, inherit: DataFrame) -> DataFrame:
    """Rejected identifiers per program, united with the parent's."""
    inherited = inherit.join(rejects.withColumnRenamed("program_id", "inherit_from"), "inherit_from")
    return rejects.unionByName(inherited.select(*rejects.columns)).distinct()


def apply_extractions(studies: DataFrame, specs: DataFrame, rejects: DataFrame, reject_all: DataFrame) -> DataFrame:
    """Reject, update or add studies keyed by (program_id, pmid). A spec wins over a rejection; its null
    fields keep the old value; specs without a study are added."""
    key = ["program_id", "pmid"]
    s = specs.select(*key, F.col("species").alias("_sp"), F.col("disease_model").alias("_dm"),
                     F.col("verification_status").alias("_vs"), F.lit(True).alias("_spec"))
    flagged = (
        studies.withColumn("_old", F.lit(True))
        .join(s, key, "full_outer")
        .join(rejects.withColumn("_rej", F.lit(True)), key, "left")
        .join(reject_all.withColumn("_all", F.lit(True)), "program_id", "left")
    )
    has_spec, old = F.col("_spec").isNotNull(), F.col("_old").isNotNull()
    rejected = F.col("_rej").isNotNull() | F.col("_all").isNotNull()
    status = F.when(has_spec, F.coalesce("_vs", F.lit("verified"))).when(rejected, "rejected").otherwise(
        F.col("verification_status"))
    action = F.when(has_spec & old, "updated").when(has_spec, "added").when(rejected, "rejected").otherwise("kept")
    return flagged.select(
        *key, F.coalesce("_sp", "species").alias("species"), F.coalesce("_dm", "disease_model").alias("disease_model"),
        status.alias("verification_status"), action.alias("action"))


def repair_dates(studies: DataFrame, known: DataFrame, fetched: DataFrame, t0: DataFrame) -> DataFrame:
    """Verified studies without a date: use a known, else a fetched one; pending when neither exists,
    rejected when it falls after t0, else updated."""
    j = (
        studies.filter((F.col("verification_status") == "verified") & F.col("publication_date").isNull())
        .drop("publication_date")
        .join(known.withColumnRenamed("publication_date", "_k"), "pmid", "left")
        .join(fetched.withColumnRenamed("publication_date", "_f"), "pmid", "left")
        .join(t0, "program_id")
    )
    d = F.coalesce("_k", "_f")
    action = F.when(d.isNull(), "pending").when(d > F.col("t0_date"), "rejected").otherwise("updated")
    return j.select("program_id", "pmid", d.alias("publication_date"), action.alias("action"))


def candidate_filter(
    candidates: DataFrame, excluded: Sequence[str], years: tuple[int, int], limit: int | None = None
) -> DataFrame:
    """Candidates that are dated, in range, phase 2/3, not excluded and whose notes mention a read-out; with a `limit`,
    the first of them in id order."""
    ok = (
        ~F.upper("ticker").isin(*excluded)
        & F.year("announcement_date").between(*years)
        & F.coalesce("stage", F.lit("")).rlike(r"(?i)Phase\s*[23]")
        & F.coalesce("notes", F.lit("")).rlike(READOUT)
    )
    kept = candidates.filter(ok)
    return kept if limit is None else kept.orderBy("candidate_id").limit(limit)


def gap_programs(programs: DataFrame, counts: DataFrame, minimum: int) -> DataFrame:
    """Programs with fewer than `minimum` known studies."""
    j = programs.join(counts, "program_id", "left")
    return j.filter(F.coalesce("n_studies", F.lit(0)) < minimum)


def cohort_load(candidates: DataFrame, existing: DataFrame, results: DataFrame, pubs: DataFrame,
                decisions: DataFrame, cap: int | None, max_pubs: int) -> DataFrame:
    """Load new candidates: pick a study, date it, label it, attach early publications.

    One row per candidate with a status: `no_study`, `t0_out_of_window` or `loaded`. `cap` is the
    batch size of the job (None loads everything).
    """
    todo = candidates.join(existing, "program_id", "left_anti")
    if cap is not None:
        todo = todo.orderBy("program_id").limit(cap)
    study = pick_study(
        results.join(todo.select("program_id", "drug", "indication_hint", "prefer_phase"), "program_id"),
        "program_id", F.col("prefer_phase"))
    labels = outcome_labels(F.col("overall_status"), F.col("why_stopped"), F.col("primary_met"))
    s = study.select(
        "program_id", "nct_id", "score",
        F.coalesce("start_date", "first_posted").alias("t0_date"),
        F.when(F.col("start_date").isNotNull(), "TRIAL_START").otherwise("OTHER").alias("t0_definition"),
        *[c.alias(n) for n, c in labels.items()])
    s = adjudicated(s, decisions, "program_id", ["clinical_success"])
    first = pre_t0_publications(pubs, s.select("program_id", "t0_date"), max_pubs)
    n_pubs = first.groupBy("program_id").agg(F.count(F.lit(1)).alias("n_publications"))
    out = todo.select("program_id").join(s, "program_id", "left").join(n_pubs, "program_id", "left")
    year = F.year("t0_date")
    status = F.when(F.col("nct_id").isNull(), "no_study").when(
        ~year.between(*T0_YEARS), "t0_out_of_window").otherwise("loaded")
    return out.withColumns({"n_publications": F.coalesce("n_publications", F.lit(0).cast("long")), "status": status})
