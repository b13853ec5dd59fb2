"""Identifier and price-source resolution, hierarchical rate lookup, two-clock facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.asof import backward_state

# Order in which providers are tried once the primary returned nothing.
CHAIN_YFINANCE = ("local_csv", "stooq", "eodhd", "polygon", "yfinance")
CHAIN_OTHER = ("polygon", "eodhd", "stooq", "local_csv", "yfinance")
# Calendar-day margins around an event.
COVER_DAYS, LOOKBACK_DAYS, LOOKAHEAD_DAYS = 7, 400, 30


def ticker_candidates(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ordered tickers to try per distinct (ticker, announcement_date): predecessors valid on that
    date in list order, the ticker itself last. `mapping`: current_ticker, before_date, use_ticker, pos."""
    keys = pairs.select(F.upper("ticker").alias("ticker"), "announcement_date").distinct()
    m = mapping.select(
        F.upper("current_ticker").alias("ticker"), "before_date", F.upper("use_ticker").alias("candidate"), "pos"
    )
    preds = (
        keys.join(m, "ticker")
        .filter((F.col("announcement_date") < F.col("before_date")) & (F.col("candidate") != ""))
        .groupBy("ticker", "announcement_date", "candidate")
        .agg(F.min("pos").alias("pos"))
    )
    own = keys.withColumns({"candidate": F.col("ticker"), "pos": F.lit(2**31 - 1).cast("long")})
    both = preds.unionByName(own).groupBy("ticker", "announcement_date", "candidate").agg(
        F.min("pos").alias("pos")
    )
    w = Window.partitionBy("ticker", "announcement_date").orderBy("pos")
    return both.withColumn("rank", F.row_number().over(w)).drop("pos")


def covering_candidate(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """First candidate whose bars reach from a week after the event back to a week before it; the
    ticker itself, flagged uncovered, when none does."""
    span = bars.groupBy(F.col("ticker").alias("candidate")).agg(
        F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count(F.lit(1)).alias("n_bars")
    )
    d = F.col("announcement_date")
    covered = (F.col("first_bar") <= F.date_add(d, COVER_DAYS)) & (
        F.col("last_bar") >= F.date_sub(d, COVER_DAYS)
    )
    best = F.min(F.when(covered, F.struct("rank", "candidate", "n_bars")))
    chosen = candidates.join(span, "candidate", "left").groupBy("ticker", "announcement_date").agg(
        best.alias("b")
    )
    return chosen.select(
        "ticker",
        "announcement_date",
        F.coalesce("b.candidate", "ticker").alias("ticker_used"),
        F.coalesce("b.n_bars", F.lit(0).cast("long")).alias("n_bars"),
    )


def provider_choice(bars: DataFrame, primary: str) -> DataFrame:
    """Provider used per ticker: the primary when it has bars, else the first in the chain that does."""
    chain = CHAIN_YFINANCE if primary == "yfinance" else CHAIN_OTHER
    order = [primary, *[p for p in chain if p != primary]]
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    return (
        bars.filter(F.col("provider").isin(*order))
        .groupBy("ticker")
        .agg(F.min_by("provider", rank).alias("provider"))
    )


def cached_or_fetched(
    cache: DataFrame, fallback: DataFrame, requests: DataFrame
) -> DataFrame:
    """Bars per request (ticker, start, end): the cache when it begins on or before `start`, cut at
    `end`; otherwise the fallback bars inside [start, end]."""
    begins = cache.groupBy("ticker").agg(F.min("date").alias("cache_start"))
    req = requests.join(begins, "ticker", "left").withColumn(
        "covered", F.coalesce(F.col("cache_start") <= F.col("start"), F.lit(False))
    )
    from_cache = cache.join(req.filter("covered"), "ticker").filter(F.col("date") <= F.col("end"))
    fetched = fallback.join(req.filter("not covered"), "ticker").filter(
        F.col("date").between(F.col("start"), F.col("end"))
    )
    cols = [*cache.columns, "covered"]
    return from_cache.select(*cols).unionByName(fetched.select(*cols))


def required_ranges(events: DataFrame) -> DataFrame:
    """First and last price date needed per ticker."""
    d = F.col("announcement_date")
    return events.groupBy("ticker").agg(
        F.min(F.date_sub(d, LOOKBACK_DAYS)).alias("price_start_required"),
        F.max(F.date_add(d, LOOKAHEAD_DAYS)).alias("price_end_required"),
        F.count(F.lit(1)).alias("n_events"),
    )


def base_rate(df: DataFrame, rates: DataFrame, phase: str, group: str, modality: str, out: str) -> DataFrame:
    """First matching rate of (phase, group, modality), (phase, group), (phase, modality), (phase).

    `rates`: phase, indication_group, modality, success_rate, row_pos. A null modality never matches.
    """
    cols = {"phase": phase, "indication_group": group, "modality": modality}
    levels = (
        ("phase", "indication_group", "modality"),
        ("phase", "indication_group"),
        ("phase", "modality"),
        ("phase",),
    )
    res = df
    for i, level in enumerate(levels):
        first = rates.groupBy(*level).agg(F.min_by("success_rate", "row_pos").alias(f"_rate{i}"))
        renamed = first.select(*[F.col(k).alias(f"_k_{k}") for k in level], f"_rate{i}")
        cond = [F.col(cols[k]) == F.col(f"_k_{k}") for k in level]
        res = res.join(renamed, cond, "left").drop(*[f"_k_{k}" for k in level])
    picked = F.coalesce(*[F.col(f"_rate{i}") for i in range(len(levels))])
    return res.withColumn(out, picked).drop(*[f"_rate{i}" for i in range(len(levels))])


def facts_as_of(
    probes: DataFrame, facts: DataFrame, fields: dict[str, Sequence[str]], unit_rank: Column
) -> DataFrame:
    """Latest filed fact per field known at each cutoff, long: (cik, cutoff, field, fact).

    A fact counts once both its period end and its filing date are on or before the cutoff. Tags are
    tried in order and the first with any hit wins; inside a tag the best available unit is used and
    the latest filing wins, the earlier record on ties. `facts`: cik, tag, filed, end, pos, val.
    """
    tag_rows = [
        F.struct(F.lit(f).alias("field"), F.lit(t).alias("tag"), F.lit(i).alias("tag_rank"))
        for f, tags in fields.items()
        for i, t in enumerate(tags)
    ]
    match = F.filter(F.array(*tag_rows), lambda s: s["tag"] == F.col("tag"))
    known = facts.filter(F.col("end").isNotNull() & F.col("filed").isNotNull())
    ranked = known.withColumns({"unit_rank": unit_rank, "known": F.greatest("end", "filed")})
    # One row per (issuer, tag, unit, day) before anything is joined.
    daily = ranked.groupBy("cik", "tag", "unit_rank", "known").agg(
        F.max(F.struct("filed", (-F.col("pos")).alias("neg_pos"), "end", "val")).alias("f")
    )
    best_unit = ranked.groupBy("cik", "tag").agg(F.min("unit_rank").alias("unit_rank"))
    usable = (
        daily.join(best_unit, ["cik", "tag", "unit_rank"])
        .select("cik", "known", "f", F.explode(match).alias("m"))
        .select(
            "cik", "known", "m.field", "m.tag", "m.tag_rank", "f.filed", "f.end", "f.val", "f.neg_pos"
        )
    )
    names = F.array(*[F.lit(f) for f in fields])
    wanted = probes.select("cik", "cutoff").distinct().withColumn("field", F.explode(names))
    priority = F.struct((-F.col("tag_rank")).alias("t"), "filed", "neg_pos")
    return backward_state(
        wanted, usable, ["cik", "field"], "cutoff", "known", priority, ["tag", "filed", "end", "val"], "fact"
    )
