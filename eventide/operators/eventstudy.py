"""Market-model event study over trading-day windows.

Per ticker one ordered pass keeps running sums of returns and cross products. Every estimation and
event window is then a difference of two running sums, so no window is ever re-scanned and no
event is joined to its 221 estimation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.asof import backward_state, nearest_session

# Estimation window, event windows and guards of the study.
EST_START, EST_END = -250, -30
EVENT_WINDOWS = {
    "[-5,+5]": (-5, 5),
    "[-1,+1]": (-1, 1),
    "[0,+1]": (0, 1),
    "[0,+5]": (0, 5),
    "[0,+20]": (0, 20),
}
MIN_ALIGNED, MAX_GAP_DAYS, MIN_EST, MIN_OLS = 80, 7, 30, 10

_SPAN = ("n", "r", "m", "x")
_COEFS = ("alpha_spy", "beta_spy", "alpha_xbi", "beta_xbi")

_PARTS = ("n", "r", "m", "x", "rm", "rx", "mm", "xx")


def _products() -> dict[str, Column]:
    r, m, x = F.col("ret"), F.col("spy"), F.col("xbi")
    return dict(zip(_PARTS, (F.lit(1.0), r, m, x, r * m, r * x, m * m, x * x)))


def parse_window(label: Column) -> tuple[Column, Column]:
    """Start and end offsets of a label such as `[-1,+1]`."""
    pattern = r"\[([+-]?\d+),([+-]?\d+)\]"
    return (
        F.regexp_extract(F.trim(label), pattern, 1).cast("int"),
        F.regexp_extract(F.trim(label), pattern, 2).cast("int"),
    )


def _line(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> tuple[Column, Column]:
    """OLS intercept and slope from sums; (0, 1) with too few pairs or a constant regressor."""
    den = n * sxx - sx * sx
    ok = (n >= MIN_OLS) & (den > 0)
    slope = F.when(ok, (n * sxy - sx * sy) / den).otherwise(F.lit(1.0))
    alpha = F.when(ok, (sy - slope * sx) / n).otherwise(F.lit(0.0))
    return alpha, slope


def session_measures(aligned: DataFrame) -> DataFrame:
    """One row per (ticker, session): index, series length, model coefficients, window measures."""
    w = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = _products()
    acc = aligned.select(
        "ticker",
        "date",
        (F.row_number().over(w) - 1).alias("idx"),
        F.count(F.lit(1)).over(whole).alias("n_sessions"),
        F.struct(*[F.sum(e).over(upto).alias(k) for k, e in parts.items()]).alias("c"),
        F.struct(*[F.sum(e).over(whole).alias(k) for k, e in parts.items()]).alias("end"),
    )
    zero = F.struct(*[F.lit(0.0).alias(k) for k in _PARTS])
    offsets = {EST_START - 1, EST_END} | {a - 1 for a, _ in EVENT_WINDOWS.values()}
    offsets |= {b for _, b in EVENT_WINDOWS.values()}

    def at(k: int) -> Column:
        if k < 0:
            return F.coalesce(F.lag("c", -k).over(w), zero)
        return F.coalesce(F.lead("c", k).over(w), F.col("end")) if k else F.col("c")

    acc = acc.withColumns({f"at_{k}".replace("-", "m"): at(k) for k in sorted(offsets)})

    def span(a: int, b: int, part: str) -> Column:
        lo, hi = f"at_{a - 1}".replace("-", "m"), f"at_{b}".replace("-", "m")
        return F.col(f"{hi}.{part}") - F.col(f"{lo}.{part}")

    e = {p: span(EST_START, EST_END, p) for p in _PARTS}
    a_s, b_s = _line(e["n"], e["m"], e["r"], e["rm"], e["mm"])
    a_x, b_x = _line(e["n"], e["x"], e["r"], e["rx"], e["xx"])
    acc = acc.withColumns(
        {"n_est": e["n"], "alpha_spy": a_s, "beta_spy": b_s, "alpha_xbi": a_x, "beta_xbi": b_x}
    )
    spans = [
        F.struct(F.lit(label).alias("window_label"), *[span(a, b, p).alias(p) for p in _SPAN])
        for label, (a, b) in EVENT_WINDOWS.items()
    ]
    return acc.select(
        "ticker", "date", "idx", "n_sessions", "n_est", *_COEFS, F.array(*spans).alias("spans")
    )


def _measures(span: str) -> dict[str, tuple[Column, str | None]]:
    """Benchmark → (CAR over the span, suffix of the model coefficients it used)."""
    n, r, m, x = (F.col(f"{span}.{p}") for p in _SPAN)
    return {
        "RAW": (r, None),
        "SPY": (r - m, None),
        "XBI": (r - x, None),
        "MARKET_MODEL": (r - n * F.col("alpha_spy") - F.col("beta_spy") * m, "spy"),
        "XBI_MODEL": (r - n * F.col("alpha_xbi") - F.col("beta_xbi") * x, "xbi"),
    }


def match_events(events: DataFrame, measures: DataFrame, bars: DataFrame) -> DataFrame:
    """Attach the matched session's measures and the guard status to each event; one without ticker or date, for which
    no price can be looked up, is kept as `price_fetch_error`.

    Sessions, distinct (ticker, date) probes and one marker per priced ticker form a single timeline
    per ticker; one pass from the latest date back carries the next session's payload to each probe.
    The calendar bounds that timeline however many events share a ticker.
    """
    payload = ["idx", "n_est", *_COEFS, "spans"]
    sessions = measures.select(
        "ticker",
        "date",
        F.struct(F.col("date").alias("session_date"), *payload).alias("_s"),
        F.lit(0).alias("_kind"),
    )
    probes = (
        events.select("ticker", F.col("announcement_date").alias("date"))
        .where("date is not null")
        .distinct()
        .withColumn("_kind", F.lit(1))
    )
    priced = bars.groupBy("ticker").agg(F.count("adj_close").alias("_n")).filter("_n > 0")
    markers = priced.select("ticker", F.lit(2).alias("_kind"))
    line = sessions.unionByName(probes, allowMissingColumns=True).unionByName(
        markers, allowMissingColumns=True
    )
    whole = Window.partitionBy("ticker")
    back = whole.orderBy(F.col("date").desc_nulls_first(), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = line.select(
        "ticker",
        F.col("date").alias("announcement_date"),
        "_kind",
        F.last("_s", ignorenulls=True).over(back).alias("_s"),
        F.count("_s").over(whole).alias("_len"),
        (F.max("_kind").over(whole) == 2).alias("_priced"),
    ).filter("_kind = 1")
    gap = F.abs(F.datediff("_s.session_date", "announcement_date"))
    status = (
        F.when(~F.col("_priced"), "no_price_data")
        .when(F.col("_len") < MIN_ALIGNED, "insufficient_history")
        .when(F.col("_s").isNull(), "no_event_date_match")
        .when(F.col("_s.idx") < -EST_START, "insufficient_pre_event_history")
        .when(gap > MAX_GAP_DAYS, "event_date_outside_price_range")
        .when(F.col("_s.n_est") < MIN_EST, "short_estimation_window")
        .otherwise("ok")
    )
    keyed = found.select("ticker", "announcement_date", "_s.*", status.alias("price_status"))
    matched = events.join(keyed, ["ticker", "announcement_date"], "left")
    return matched.withColumn("price_status", F.coalesce("price_status", F.lit("price_fetch_error")))


def event_study(events: DataFrame, aligned: DataFrame, bars: DataFrame) -> DataFrame:
    """Long result: 25 rows (window × benchmark) per usable event, one row per failed event."""
    matched = match_events(events, session_measures(aligned), bars)
    ok = F.col("price_status") == "ok"
    base = [*events.columns, "price_status"]
    spans = matched.select(*base, *_COEFS, F.explode_outer(F.when(ok, F.col("spans"))).alias("w"))
    null = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("benchmark"),
            (value if name == "RAW" else null).alias("raw_return"),
            value.alias("car"),
            (F.col(f"alpha_{model}") if model else null).alias("alpha"),
            (F.col(f"beta_{model}") if model else null).alias("beta"),
        )
        for name, (value, model) in _measures("w").items()
    ]
    usable = F.when(F.col("w").isNotNull(), F.array(*rows))
    return spans.select(
        *base, F.col("w.window_label").alias("window_label"), F.explode_outer(usable).alias("x")
    ).select(*base, "window_label", "x.*")


def primary_car(events: DataFrame, aligned: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per usable event with its market-model CAR over [-1,+1]; the other 24 measures are
    never materialised."""
    matched = match_events(events, session_measures(aligned), bars)
    pos = list(EVENT_WINDOWS).index("[-1,+1]")
    car, _ = _measures("w")["MARKET_MODEL"]
    return (
        matched.filter(F.col("price_status") == "ok")
        .withColumn("w", F.col("spans")[pos])
        .select(*events.columns, car.alias("car"))
    )


def legacy_study(events: DataFrame, aligned: DataFrame) -> DataFrame:
    """Older variant: estimation on every date more than 30 calendar days before the event (at least
    30 of 60 aligned), the nearest session as event day, CAR over the session before to the one after.

    Coefficients depend only on the last session inside the estimation span, so running sums at that
    session, found by a backward as-of pass, replace a range join.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r, m = F.col("ret"), F.col("spy")
    run = aligned.select(
        "ticker", "date",
        (F.row_number().over(w) - 1).alias("idx"), F.count(F.lit(1)).over(whole).alias("len"),
        F.sum(F.lit(1.0)).over(upto).alias("n"), F.sum(m).over(upto).alias("m"), F.sum(r).over(upto).alias("r"),
        F.sum(r * m).over(upto).alias("rm"), F.sum(m * m).over(upto).alias("mm"),
        F.sum(r).over(w.rowsBetween(-1, 1)).alias("r3"), F.sum(m).over(w.rowsBetween(-1, 1)).alias("m3"),
    )
    alpha, beta = _line(F.col("n"), F.col("m"), F.col("r"), F.col("rm"), F.col("mm"))
    run = run.withColumns({"alpha": alpha, "beta": beta})
    probes = events.select("ticker", "announcement_date").distinct().withColumn(
        "est_until", F.date_sub("announcement_date", 30)
    )
    with_est = backward_state(
        probes, run, ["ticker"], "est_until", "date", F.col("date"), ["n", "alpha", "beta"], "e", strict=True
    )
    near = nearest_session(with_est, run, "ticker", "announcement_date", "date", "session_date")
    at = run.select("ticker", F.col("date").alias("session_date"), "idx", "len", "r3", "m3")
    ok = near.join(at, ["ticker", "session_date"]).filter(
        (F.col("len") >= 60) & (F.col("e.n") >= MIN_EST) & (F.col("idx") >= 1) & (F.col("idx") < F.col("len") - 1)
    )
    car = F.col("r3") - 3 * F.col("e.alpha") - F.col("e.beta") * F.col("m3")
    keyed = ok.select("ticker", "announcement_date", car.alias("car"), "e.alpha", "e.beta")
    return events.join(keyed, ["ticker", "announcement_date"])


def recovery_delta(events: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of events with a CAR in the first and second run, gained, and still missing."""
    flags = (
        events.select("catalyst_id")
        .join(before.select("catalyst_id", F.lit(1).alias("b")), "catalyst_id", "left")
        .join(after.select("catalyst_id", F.lit(1).alias("a")), "catalyst_id", "left")
    )
    return flags.agg(
        F.count("b").alias("n_before"),
        F.count("a").alias("n_after"),
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNull(), 1)).alias("n_recovered"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("n_still_missing"),
    )
