"""Point-in-time cutoffs, masks and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(col: Column | str) -> Column:
    """First ten characters read as a date; unparsable text is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def trading_cutoffs(df: DataFrame, date: str, timing: str) -> DataFrame:
    """After-close events trade on the same day, everything else on the calendar day before."""
    t = F.upper(F.coalesce(F.col(timing), F.lit("UNKNOWN")))
    cutoff = F.when(t == "AMC", F.col(date)).otherwise(F.date_sub(date, 1))
    confidence = F.when(t == "AMC", "MEDIUM").when(t == "BMO", "HIGH").otherwise("LOW")
    return df.withColumns(
        {
            "trading_cutoff_date": cutoff,
            "trading_day_before": cutoff,
            "first_trading_day_after": F.date_add(date, 1),
            "execution_confidence": confidence,
        }
    )


def feature_cutoff(
    entry: str = "entry_cutoff_date",
    trading: str = "trading_cutoff_date",
    announced: str = "announcement_date",
) -> Column:
    return F.coalesce(entry, trading, announced)


def point_in_time(observed: Column, cutoff: Column) -> Column:
    """True only when both moments are known and the observation is not later than the cutoff.

    The comparison is made on timestamps: a reading later on the cutoff day fails a midnight cutoff.
    """
    return F.coalesce(observed.cast("timestamp") <= cutoff.cast("timestamp"), F.lit(False))


def sanitize_family(
    df: DataFrame, columns: Sequence[str], observed: str, cutoff: str, flag: str
) -> DataFrame:
    """Null a whole feature family where its observation time is not provably before the cutoff."""
    flagged = df.withColumn(flag, point_in_time(F.col(observed), F.col(cutoff)))
    present = [c for c in columns if c in df.columns]
    return flagged.withColumns({c: F.when(F.col(flag), F.col(c)) for c in present})


def latest_safe_date(families: dict[str, str]) -> Column:
    """Latest observation date among families whose flag is true (`flag → observed column`)."""
    dates = [F.when(F.col(flag), F.col(obs).cast("date")) for flag, obs in families.items()]
    return F.greatest(*dates) if len(dates) > 1 else dates[0]


def labelled_only(success: str = "clinical_success", car: str = "car") -> Column:
    return F.col(success).isNotNull() & F.col(car).isNotNull()


def before_locked_holdout(date: str, start: str) -> Column:
    return F.col(date) < F.lit(start).cast("date")


def holdout_split(year: Column, start: int, end: int) -> Column:
    """`train` before the locked years, `test` inside them, null after."""
    return F.when(year < start, "train").when((year >= start) & (year <= end), "test")


def temporal_split(year: Column) -> Column:
    return (
        F.when(year <= 2016, "train")
        .when((year >= 2017) & (year <= 2018), "validation")
        .when(year >= 2019, "test")
        .otherwise("train")
    )


def in_t0_window(date: Column, first_year: int, last_year: int) -> Column:
    """Start dates inside the cohort's years; an unknown date is not held against a program."""
    year = F.year(date)
    return F.coalesce(year.between(first_year, last_year), F.lit(True))


def phase_has(phase: Column, number: str) -> Column:
    """A registry phase such as PHASE2 or PHASE1/PHASE2 has the given phase among its parts; false without a phase."""
    parts = F.split(F.upper(phase), "/")
    return F.coalesce(F.exists(parts, lambda p: p.contains(number)), F.lit(False))


def stage_mentions(stage: Column, *phases: str) -> Column:
    """A free-text stage mentions one of the phases; false without a stage."""
    low = F.lower(stage)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(f"phase {p}") for p in phases]), F.lit(False))


def effective_public_date(*dates: str) -> Column:
    """Earliest known publication date."""
    return F.least(*dates)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
