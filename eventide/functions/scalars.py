"""Column functions: text flags, phases, dates, exposure, costs and signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric phase scale; anything else reads as 2.0.
PHASE_NUMERIC = {
    "EARLY_PHASE1": 0.5,
    "PHASE1": 1.0,
    "PHASE1/PHASE2": 1.5,
    "PHASE2": 2.0,
    "PHASE2/PHASE3": 2.5,
    "PHASE3": 3.0,
    "PHASE4": 4.0,
}

# Endpoint families recognised as whole words in outcome texts (lower case, as patterns).
ENDPOINT_PHRASES = {
    "endpoint_os": ("overall survival", "os"),
    "endpoint_pfs": ("progression.free survival", "pfs", "progression free"),
    "endpoint_orr": ("objective response", "orr", "response rate", "overall response"),
    "endpoint_safety": ("safety", "tolerability", "adverse event", "mtb?d"),
}
_WORD = r"[\p{L}\p{N}_]"

# Words that mark a combination regimen, and masking values that mean not blinded.
COMBO_MARKERS = (" plus ", " + ", " in combination", "combined with", " and ")
OPEN_MASKS = ("", "NONE", "NA", "OPEN LABEL")

# Indications bucketed as oncology-like.
ONCOLOGY = (
    "(?i)NSCLC|melanoma|breast|AML|DLBCL|RCC|ovarian|TNBC|lymphoma|myeloma|HCC|CLL"
)

# Month names of publication dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def normalize_name(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 become one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def whole_words(phrases: tuple[str, ...]) -> str:
    """Pattern for any phrase between word boundaries in any alphabet. The phrase comes first and its
    surroundings are checked after, which is far cheaper than testing a boundary at every character."""
    return "|".join(f"{p}(?!{_WORD})(?<!{_WORD}{p})" for p in phrases)


def endpoint_flags(text: Column) -> dict[str, Column]:
    """Binary flag per endpoint family; `text` is the joined outcome text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: low.rlike(whole_words(p)).cast("int") for name, p in ENDPOINT_PHRASES.items()}


def phase_numeric(phase: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PHASE_NUMERIC.items() for x in kv])
    return F.coalesce(table[F.upper(phase)], F.lit(2.0))


def is_combination(interventions_json: Column) -> Column:
    """1 for a JSON list of several items or one whose text carries a combination marker."""
    items = F.from_json(interventions_json, "array<string>")
    text = F.lower(F.array_join(items, " "))
    marker = F.lit(False)
    for m in COMBO_MARKERS:
        marker = marker | text.contains(m)
    return F.coalesce((F.size(items) > 1) | marker, F.lit(False)).cast("int")


def log_enrollment(n: Column) -> Column:
    return F.when(n > 0, F.log1p(n.cast("double")))


def is_blinded(masking: Column) -> Column:
    return (~F.upper(F.coalesce(masking, F.lit(""))).isin(*OPEN_MASKS)).cast("int")


def is_randomized(allocation: Column) -> Column:
    return (F.upper(F.coalesce(allocation, F.lit(""))) == "RANDOMIZED").cast("int")


def partial_date(c: Column) -> Column:
    """`Y`, `Y-M` or `Y-M-D` (month as number or English name) → first day of the named period."""
    parts = F.split(c, "-")
    month_raw = F.when(F.size(parts) > 1, parts[1]).otherwise(F.lit("1"))
    by_name = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month_raw, 1, 3))
    )
    month = F.when(month_raw.rlike("^[0-9]+$"), month_raw.try_cast("int")).when(by_name > 0, by_name.cast("int"))
    day = F.when(F.size(parts) > 2, parts[2]).otherwise(F.lit("1"))
    text = F.concat_ws(
        "-",
        F.lpad(parts[0], 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day, 2, "0"),
    )
    ok = c.isNotNull() & month.isNotNull()
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def mixed_date(c: Column) -> Column:
    """`m/d/Y` text, or a spreadsheet serial counted in days from 1899-12-30."""
    slash = F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")
    serial = F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("double").cast("int"))
    return F.when(c.contains("/"), slash).otherwise(serial)


def vendor_symbol(ticker: Column, suffix: str) -> Column:
    """Upper-cased ticker with the vendor suffix unless it already names a market."""
    t = F.upper(ticker)
    return F.when(t.contains("."), t).otherwise(F.concat(t, F.lit(suffix)))


def cap_dependency(market_cap: Column) -> Column:
    return (
        F.when(market_cap >= 50e9, 0.15).when(market_cap >= 5e9, 0.45).when(market_cap > 0, 0.85)
    )


def enhanced_dependency(
    base: Column, lead: Column, single: Column, phase: Column, large_cap: Column
) -> Column:
    """Capped additions for lead asset, single asset and late phase, then the large-cap discount."""
    s = base
    for cond, add in ((lead == 1, 0.05), (single == 1, 0.05), (phase >= 3, 0.03)):
        s = F.when(F.coalesce(cond, F.lit(False)), F.least(F.lit(1.0), s + add)).otherwise(s)
    discounted = F.greatest(F.lit(0.10), s - 0.10)
    return F.when(F.coalesce(large_cap == 1, F.lit(False)), discounted).otherwise(s)


def expected_car(p_fail: Column, car_fail: Column, car_ok: Column, dependency: Column | None = None) -> Column:
    dep = dependency if dependency is not None else F.lit(1.0)
    return p_fail * car_fail * dep + (F.lit(1.0) - p_fail) * car_ok * dep


def slippage_cost(bps: Column) -> Column:
    return F.lit(2.0) * (bps / F.lit(10000.0))


def borrow_cost(bps_annual: float = 300.0, hold_days: float = 3.0) -> float:
    return (bps_annual / 10000.0) * (hold_days / 252.0)


def short_return(realized_car: Column, bps: Column | float = 25.0) -> Column:
    """Short P&L after round-trip slippage and prorated borrow."""
    b = F.lit(float(bps)) if isinstance(bps, (int, float)) else bps
    return -realized_car - slippage_cost(b) - F.lit(borrow_cost())


def percentile_signal(pct: Column) -> Column:
    return (
        F.when(pct >= 0.90, "STRONG LONG")
        .when(pct >= 0.75, "LONG")
        .when(pct <= 0.10, "STRONG SHORT")
        .when(pct <= 0.25, "SHORT")
        .otherwise("NO TRADE")
    )


def fixed_signal(x: Column) -> Column:
    return (
        F.when(x > 0.05, "STRONG LONG")
        .when(x > 0.03, "LONG")
        .when(x < -0.05, "STRONG SHORT")
        .when(x < -0.03, "SHORT")
        .otherwise("NO_TRADE")
    )


def confidence_signal(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "CONFIDENT LONG").when(hi < 0, "CONFIDENT SHORT").otherwise("UNCERTAIN")


def side_of(signal: Column, fallback: Column | None = None) -> Column:
    """+1/−1 for long/short signals, else 0; `fallback` opts into the ±0.03 expectation rule."""
    side = F.when(signal.isin("LONG", "STRONG LONG"), 1).when(signal.isin("SHORT", "STRONG SHORT"), -1)
    if fallback is not None:
        side = side.when(fallback > 0.03, 1).when(fallback < -0.03, -1)
    return side.otherwise(0)


def threshold_side(x: Column, minimum: Column) -> Column:
    return F.when(x <= -minimum, -1).when(x >= minimum, 1).otherwise(0)


def outcome_category(success: Column, technical: Column, safety: Column, unknown: Column) -> Column:
    """Registry rule: unknown, then success, then safety before efficacy failures."""
    yes = lambda c: F.coalesce(c, F.lit(0)) != 0
    return (
        F.when(yes(unknown), "UNKNOWN")
        .when(yes(success), "SUCCESS")
        .when(yes(safety), "SAFETY_FAILURE")
        .when(yes(technical), "EFFICACY_FAILURE")
        .otherwise("MIXED")
    )
