"""Name matching between event registries.

Names repeat far more often than rows, so similarity is scored once per distinct pair of names that
share a ticker and come from neighbouring years. Scored pairs are then joined to the dated rows, each with the nearest event only:
first the best-scoring names of each name, then, for the rows that these leave without an event in reach, the others.

Most pairs are ruled out before they are scored, inside the join, by a bound that never exceeds the edit distance: letters that
one name has and the other lacks. A busy ticker is dealt over as many tasks as its number of pairs asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.scalars import normalize_name
from eventide.operators.registry import dedupe_first
from eventide.session import spread, stable

# Score floors, day limits and status bounds of the matcher.
MIN_SCORE, CONTAIN_SCORE, WINDOW_DAYS = 0.45, 0.95, 365
DUPLICATE_SCORE = 0.6
EXACT_DAYS, CLOSE_DAYS, MODERATE_DAYS = 7, 30, 90
SUGGEST_SCORE, SUGGEST_DAYS = 0.7, 30
INFERRED_SOURCES = ("INFERRED_T0_PLUS_18MO", "INFERRED_CTGOV_RESULTS", "LEGACY_UNTAGGED")
#: Pairs of names that one task compares, about.
PAIRS_A_TASK = 2_000_000


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def similarity(a: Column, b: Column, ratio) -> Column:
    """0 for an empty name, 0.95 when one contains the other, else the ratio."""
    contains = a.contains(b) | b.contains(a)
    return F.when((a == "") | (b == ""), 0.0).when(contains, CONTAIN_SCORE).otherwise(ratio(a, b))


def _year_block(date: str) -> Column:
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / (WINDOW_DAYS + 1))


def letters(name: Column) -> Column:
    """A 64-bit signature: for each letter a-z whether it occurs once and whether it occurs again, and which digits occur (0 and 1
    as one, 2 and 3, ...), with the last bit for any other character but a space."""
    kinds = [(chr(c), 2) for c in range(ord("a"), ord("z") + 1)]
    out, bit = F.lit(0).cast("long"), 0
    for c, most in kinds:
        n = F.length(name) - F.length(F.replace(name, F.lit(c), F.lit("")))
        for k in range(1, most + 1):
            out = out.bitwiseOR(F.when(n >= k, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
            bit += 1
    for low in range(0, 10, 2):
        out = out.bitwiseOR(F.when(name.rlike(f"[{low}{low + 1}]"), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
        bit += 1
    return out.bitwiseOR(F.when(name.rlike("[^a-z0-9 ]"), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))


def least_edits(a: Column, b: Column, sig_a: Column, sig_b: Column) -> Column:
    """A lower bound of the edit distance: each edit adds at most one letter of a signature to a name, or takes one from it."""
    lacks = F.greatest(F.bit_count(sig_a.bitwiseAND(F.bitwise_not(sig_b))), F.bit_count(sig_b.bitwiseAND(F.bitwise_not(sig_a))))
    return F.greatest(lacks, F.abs(F.length(a) - F.length(b)))


def possible(a: Column, b: Column, sig_a: Column, sig_b: Column, floor: float) -> Column:
    """False only where the bound on the edit distance rules the floor out and neither name contains the other."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.lit(1.0) - least_edits(a, b, sig_a, sig_b) / longest >= floor) | a.contains(b) | b.contains(a)


def candidate_names(left: DataFrame, right: DataFrame, dated: bool = True, floor: float = MIN_SCORE) -> DataFrame:
    """(ticker, name, other) of distinct names sharing a ticker (and, when dated, lying within neighbouring year blocks) that may
    reach `floor`. The names of a key are dealt out by its number of pairs, so ordinary keys are not copied."""
    cols = ["ticker", "block"] if dated else ["ticker"]
    block = {"block": F.explode(F.array(*[_year_block("event_date") + d for d in (-1, 0, 1)]))} if dated else {}
    l = left.select(*cols, "name").distinct()
    r = right.withColumns(block).select(*cols, F.col("name").alias("other")).distinct()
    count = {side: df.groupBy(*cols).agg(F.count("*").alias(f"_n_{side}")) for side, df in (("l", l), ("r", r))}
    salts = F.ceil(F.col("_n_l") * F.col("_n_r") / PAIRS_A_TASK).cast("int")
    busy = count["l"].join(count["r"], cols).select(*cols, F.least(salts, F.col("_n_l").cast("int")).alias("_salts"))
    l = l.join(busy, cols).withColumn("_salt", F.pmod(F.xxhash64("name"), F.col("_salts")).cast("int")).drop("_salts")
    r = r.join(busy, cols).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    l, r = l.withColumn("_sig_l", letters(F.col("name"))), r.withColumn("_sig_r", letters(F.col("other")))
    near_enough = possible(F.col("name"), F.col("other"), F.col("_sig_l"), F.col("_sig_r"), floor)
    return l.join(r, [*cols, "_salt"]).filter(near_enough).select("ticker", "name", "other").distinct()


def scored_names(
    left: DataFrame, right: DataFrame, ratio=levenshtein_ratio, dated: bool = True, floor: float = MIN_SCORE
) -> DataFrame:
    """(ticker, name, other, score) of the candidate pairs of names. The bound holds for edit ratios, the default."""
    pairs = candidate_names(left, right, dated, floor)
    return pairs.withColumn("score", similarity(F.col("name"), F.col("other"), ratio))


def nearest_days(pairs: DataFrame, days: DataFrame) -> DataFrame:
    """(ticker, other, announcement_date, gap, event_date, drug, event_id): the event of `other` nearest to each date in `pairs`, the
    earlier one of a tie. `days` holds one row per (ticker, other, event_date); one ordered pass per (ticker, other), which the
    calendar bounds, finds the event before and after each date, so that events are never paired with dates."""
    probes = pairs.select("ticker", "other", F.col("announcement_date").alias("_d")).distinct().withColumn("_probe", F.lit(1))
    marks = days.where("event_date is not null").select(
        "ticker", "other", F.col("event_date").alias("_d"), F.struct("event_date", "drug", "event_id").alias("_e"), F.lit(0).alias("_probe"))
    line = spread(marks.unionByName(probes, allowMissingColumns=True), "ticker", "other")
    name, span = Window.partitionBy("ticker", "other"), (Window.unboundedPreceding, Window.currentRow)
    both = line.withColumns({
        "_prev": F.last("_e", ignorenulls=True).over(name.orderBy("_d", "_probe").rowsBetween(*span)),
        "_next": F.last("_e", ignorenulls=True).over(name.orderBy(F.col("_d").desc(), "_probe").rowsBetween(*span)),
    }).filter("_probe = 1")
    back, ahead = F.datediff("_d", "_prev.event_date"), F.datediff("_next.event_date", "_d")
    near = F.when(F.col("_prev").isNull() | (ahead < back), F.col("_next")).otherwise(F.col("_prev"))
    found = both.select("ticker", "other", F.col("_d").alias("announcement_date"), F.least(back, ahead).alias("gap"), near.alias("_e"))
    return found.select("ticker", "other", "announcement_date", "gap", "_e.*")


def _best_events(keys: DataFrame, names: DataFrame, days: DataFrame) -> DataFrame:
    """The best event within reach of each dated key, of the names that score with its own: highest score, then nearest. A key meets
    each name once, with that name's nearest event: no other event of the name can be better."""
    pairs = keys.join(names, ["ticker", "name"])
    cand = pairs.join(nearest_days(pairs, days), ["ticker", "other", "announcement_date"]).filter(F.col("gap") <= WINDOW_DAYS)
    return dedupe_first(
        cand.select("ticker", "name", "announcement_date", "score", "gap", "event_date", "drug", "event_id"),
        ["ticker", "name", "announcement_date"], [-F.col("score"), F.col("gap"), F.col("event_date"), F.col("event_id")])


def match_events(registry: DataFrame, events: DataFrame, ratio=levenshtein_ratio) -> DataFrame:
    """Best external event per registry row: highest score, then smallest day difference.

    `registry`: catalyst_id, ticker, drug_name, announcement_date, announcement_source. `events`:
    event_id, ticker, drug, event_date. Rows without a partner stay with status NO_MATCH.
    """
    reg = registry.withColumns({
        "tk": F.upper("ticker"), "name": normalize_name(F.col("drug_name")), "block": _year_block("announcement_date")})
    ext = events.select(
        F.upper("ticker").alias("ticker"), normalize_name(F.col("drug")).alias("name"), "event_date", "event_id", "drug")
    names = scored_names(
        reg.select(F.col("tk").alias("ticker"), "name", "block"), ext, ratio).filter(F.col("score") >= MIN_SCORE)
    names = stable(spread(names, "ticker", "name"))  # dealt out like the keys, which expand where they meet
    # Distinct (ticker, name, date) keys carry the match; rows sharing one are joined back once.
    key, rows = ["ticker", "name", "announcement_date"], registry.count()
    dated = reg.select(F.col("tk").alias("ticker"), "name", "announcement_date").filter("announcement_date is not null")
    keys = spread(dated.distinct(), "ticker", "name", rows=rows)  # the calendar bounds a name's dates
    days = dedupe_first(ext, ["ticker", "name", "event_date"], ["event_id"]).withColumnRenamed("name", "other")
    # An event of the best-scoring names beats all others: only keys that have none in reach meet the other names.
    top = names.groupBy("ticker", "name").agg(F.max("score").alias("_top"))
    ranked = names.join(top, ["ticker", "name"])
    first = stable(_best_events(keys, ranked.filter("score = _top").drop("_top"), days))
    rest = spread(keys.join(first.select(*key), key, "left_anti"), "ticker", "name", rows=rows)
    best = first.unionByName(_best_events(rest, ranked.filter("score < _top").drop("_top"), days)).withColumnRenamed("ticker", "tk")
    out = reg.join(best, ["tk", "name", "announcement_date"], "left")
    status = (
        F.when(F.col("gap").isNull(), "NO_MATCH").when(F.col("gap") <= EXACT_DAYS, "EXACT")
        .when(F.col("gap") <= CLOSE_DAYS, "CLOSE").when(F.col("gap") <= MODERATE_DAYS, "MODERATE_DRIFT")
        .otherwise("LARGE_DRIFT")
    )
    return out.select(
        *registry.columns, F.col("event_date").alias("matched_date"), F.col("drug").alias("matched_drug"),
        F.datediff("event_date", "announcement_date").alias("date_delta_days"),
        F.round("score", 3).alias("drug_score"), status.alias("match_status"))


def suggest_corrections(matches: DataFrame) -> DataFrame:
    """Drifted matches good enough to correct an inferred (or untagged) date."""
    src = F.col("announcement_source")
    return matches.filter(
        F.col("match_status").isin("MODERATE_DRIFT", "LARGE_DRIFT")
        & (F.abs("date_delta_days") >= SUGGEST_DAYS)
        & (F.col("drug_score") >= SUGGEST_SCORE)
        & (src.isNull() | src.isin(*INFERRED_SOURCES))
    ).select("catalyst_id", "ticker", F.col("matched_date").alias("announcement_date"), "date_delta_days", "drug_score")


def largest_drifts(matches: DataFrame, n: int = 20) -> DataFrame:
    drift = matches.filter(F.col("match_status").isin("MODERATE_DRIFT", "LARGE_DRIFT"))
    return drift.orderBy(F.abs("date_delta_days").desc(), "catalyst_id").limit(n)


def new_candidates(events: DataFrame, registry: DataFrame, cap: int | None, ratio=levenshtein_ratio) -> DataFrame:
    """External events not represented in the registry: one row per (ticker, name, date), dropped when a
    registry name of the same ticker scores 0.6 or more or contains it; numbered by date.

    `cap` is the size of the review list (None keeps all).
    """
    ext = events.select(
        F.upper("ticker").alias("ticker"), normalize_name(F.col("drug")).alias("name"), "event_date", "event_id", "drug")
    once = dedupe_first(ext, ["ticker", "name", "event_date"], ["event_id"])
    reg = registry.select(F.upper("ticker").alias("ticker"), normalize_name(F.col("drug_name")).alias("name")).distinct()
    pairs = scored_names(once, reg, ratio, dated=False, floor=DUPLICATE_SCORE)
    a, b = F.col("name"), F.col("other")
    known = pairs.filter((F.col("score") >= DUPLICATE_SCORE) | a.contains(b) | b.contains(a)).select("ticker", "name").distinct()
    fresh = once.join(known, ["ticker", "name"], "left_anti")
    return fresh.orderBy("event_date", "ticker", "name").limit(cap) if cap is not None else fresh
