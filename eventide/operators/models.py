"""Success, conditional-return and tail models, and the expanding walk-forward.

All training windows of a walk-forward are fitted together (`operators/windows.py`): two passes give medians, scalers and
ridge fits, one pass per Newton step all logistic fits, one pass all predictions. Sums and coefficients reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators.cutoffs import before_locked_holdout
from eventide.operators.windows import Fitted, LinearScore, Logistic, Scaler, logistic_fits, scored_by_year, statistics

# Penalties, minimum sample sizes, defaults and thresholds of the study.
RETURN_ALPHA, SHORT_ALPHA = 1.0, 5.0
MIN_RETURN_ROWS, MIN_SHORT_ROWS, MIN_TAIL_ROWS = 5, 8, 5
SUCCESS_DEFAULT, FAILURE_DEFAULT = 0.0, -0.10
SHORT_SUCCESS_DEFAULT, SHORT_FAILURE_DEFAULT = -0.003, -0.10
SHRINKAGE_K = 8.0
MAJOR_DROP = -0.20
MIN_TRAIN, MIN_SHORT_TRAIN = 10, 15
# Fixed value: first day of the locked holdout.
LOCKED_FROM = "2022-01-01"
THRESHOLDS = (0.35, 0.45, 0.50, 0.55, 0.65)
CONFIG_THRESHOLD = 0.50
PROVENANCE = "strict_point_in_time_sanitized"


def fit_scalers(df: DataFrame, subsets: dict[str, Column], cols: Sequence[str]) -> dict[str, Scaler]:
    """Scalers of several row subsets in two passes over df: exact medians, then means and deviations of the imputed columns.

    A column without values is imputed with 0 and a constant column is scaled by 1.
    """
    found = statistics(df, cols, subsets, [(name, None) for name in subsets])
    return {name: found.scaler((name, None)) for name in subsets}


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    return fit_scalers(df, {"all": F.lit(True)}, cols)["all"]


def fit_logistic(
    df: DataFrame, cols: Sequence[str], label: str, c: float = 1.0, max_iter: int = 100, balanced: bool = True, scaler: Scaler | None = None,
) -> LinearScore:
    """L2 logistic with balanced class weights n / (2·n_k) by default, penalty 1 / (2·C), free intercept."""
    rows = df.filter(F.col(label).isNotNull())
    parts = {"all": F.lit(True)}
    scaler = scaler or fit_scaler(rows, cols)
    found = logistic_fits(rows, {"all": Logistic(("all", None), label, scaler, balanced)}, parts, c=c, max_iter=max_iter)
    if not found:
        raise ValueError("logistic fit needs both classes")
    return found["all"]


def fit_ridge(
    df: DataFrame, cols: Sequence[str], label: str, alpha: float, scaler: Scaler | None = None
) -> LinearScore:
    """Ridge with an unpenalised intercept, by one pass of normal equations."""
    rows = df.filter(F.col(label).isNotNull())
    return statistics(rows, cols, {"all": F.lit(True)}, [("all", None)], label).ridge(("all", None), alpha, scaler=scaler)


def outcome_means(df: DataFrame, outcome: str, car: str, success: float, failure: float) -> tuple[float, float]:
    """Mean CAR of successes and of failures in the training rows, with defaults for empty classes."""
    y = F.col(outcome)
    s, f = df.agg(F.avg(F.when(y == 1, F.col(car))), F.avg(F.when(y == 0, F.col(car)))).first()
    return (success if s is None else s), (failure if f is None else f)


def shrink(mean: Column, n: Column, overall: Column, k: float = SHRINKAGE_K) -> Column:
    """Mean pulled toward the overall mean with weight n / (n + k); the overall mean when n = 0."""
    w = n / (n + F.lit(float(k)))
    return F.when(n > 0, w * mean + (F.lit(1.0) - w) * overall).otherwise(overall)


@dataclass
class ExpectedCar:
    """P(success) and the two conditional return models, with training-only fallbacks."""

    p_success: LinearScore
    success: LinearScore | None
    failure: LinearScore | None
    success_mean: float
    failure_mean: float
    policy: str = "unverified"
    metrics: dict = field(default_factory=dict)


def expected_parts() -> dict[str, Column]:
    """Training rows of the success model (p) and of the two return models (1, 0)."""
    y, car = F.col("clinical_success"), F.col("realized_car").isNotNull()
    return {"p": y.isNotNull(), "1": (y == 1) & car, "0": (y == 0) & car}


def expected_car_of(found: Fitted, p_model: LinearScore, car_cols: Sequence[str], end: int | None) -> ExpectedCar:
    """A fitted success model with the return models of its window."""
    ridge = {k: found.ridge((k, end), RETURN_ALPHA, car_cols) if found.count((k, end)) >= MIN_RETURN_ROWS else None for k in "10"}
    s, f = found.target_mean(("1", end)), found.target_mean(("0", end))
    return ExpectedCar(p_model, ridge["1"], ridge["0"], SUCCESS_DEFAULT if s is None else s, FAILURE_DEFAULT if f is None else f, PROVENANCE)


def fit_expected_cars(
    frame: DataFrame, p_cols: Sequence[str], car_cols: Sequence[str], ends: Sequence[int | None] = (None,), year: str | None = None
) -> dict[int | None, ExpectedCar]:
    """The models of every training window (rows up to each end year), fitted together. `frame` should be materialised."""
    parts = expected_parts()
    found = statistics(frame, [*p_cols, *car_cols], parts, [(p, e) for e in ends for p in parts], "realized_car", year)
    fits = {e: Logistic(("p", e), "clinical_success", found.scaler(("p", e), p_cols)) for e in ends}
    p_models = logistic_fits(frame, fits, parts, year)
    if len(p_models) < len(fits):
        raise ValueError("logistic fit needs both classes")
    return {e: expected_car_of(found, p_models[e], car_cols, e) for e in ends}


def fit_expected_car(train: DataFrame, p_cols: Sequence[str], car_cols: Sequence[str]) -> ExpectedCar:
    return fit_expected_cars(train, p_cols, car_cols)[None]


def expected_car_columns(m: ExpectedCar) -> tuple[Column, Column]:
    """(probability of success, expected CAR)."""
    p = m.p_success.probability()
    s = m.success.linear() if m.success else F.lit(float(m.success_mean))
    f = m.failure.linear() if m.failure else F.lit(float(m.failure_mean))
    return p, p * s + (1 - p) * f


def predict_expected_car(df: DataFrame, m: ExpectedCar) -> DataFrame:
    p = m.p_success.probability()
    s = m.success.linear() if m.success else F.lit(float(m.success_mean))
    f = m.failure.linear() if m.failure else F.lit(float(m.failure_mean))
    out = df.withColumns({"p_success": p, "e_car_given_success": s, "e_car_given_failure": f})
    mix = F.col("p_success") * F.col("e_car_given_success") + (1 - F.col("p_success")) * F.col("e_car_given_failure")
    return out.withColumn("expected_car", mix)


def predict_base_rate(df: DataFrame, calibration: DataFrame, rate: str) -> DataFrame:
    """Baseline: the looked-up base rate (mean success of the calibration rows where missing) with
    conditional means frozen on the calibration rows."""
    s, f = outcome_means(calibration, "clinical_success", "realized_car", SUCCESS_DEFAULT, FAILURE_DEFAULT)
    prior = calibration.agg(F.avg("clinical_success")).first()[0]
    p = F.coalesce(F.col(rate), F.lit(prior).cast("double"))
    return df.withColumns({
        "p_success": p,
        "e_car_given_success": F.lit(float(s)),
        "e_car_given_failure": F.lit(float(f)),
        "expected_car": p * float(s) + (1 - p) * float(f),
    })


@dataclass
class TailRisk:
    classifier: LinearScore | None
    magnitude: LinearScore | None
    constant_probability: float
    fallback_magnitude: float
    n_rows: int = 0
    n_drops: int = 0


def _tail_parts(threshold: float) -> dict[str, Column]:
    car = F.col("realized_car")
    return {"all": car.isNotNull(), "drop": car <= threshold}


def _tail_risk(found: Fitted, classifier: LinearScore | None, cols: Sequence[str], end: int | None, threshold: float) -> TailRisk:
    n, k, mean = found.count(("all", end)), found.count(("drop", end)), found.target_mean(("drop", end))
    magnitude = found.ridge(("drop", end), SHORT_ALPHA, cols) if k >= MIN_TAIL_ROWS else None
    return TailRisk(classifier, magnitude, k / n if n else 0.0, threshold if mean is None else mean, n, k)


def _flagged(frame: DataFrame, threshold: float) -> DataFrame:
    return frame.withColumn("_drop", (F.col("realized_car") <= threshold).cast("int"))


def fit_tail_risks(
    frame: DataFrame, cols: Sequence[str], ends: Sequence[int | None] = (None,), threshold: float = MAJOR_DROP, year: str | None = None
) -> dict[int | None, TailRisk]:
    """Drop classifier (a constant rate when the window has one class) and drop magnitude (the training mean when there are
    fewer than five drops) of every training window, fitted together."""
    parts = _tail_parts(threshold)
    found = statistics(frame, cols, parts, [(p, e) for e in ends for p in parts], "realized_car", year)
    fits = {e: Logistic(("all", e), "_drop", found.scaler(("all", e), cols)) for e in ends}
    classifiers = logistic_fits(_flagged(frame, threshold), fits, parts, year)
    return {e: _tail_risk(found, classifiers.get(e), cols, e, threshold) for e in ends}


def fit_tail_risk(train: DataFrame, cols: Sequence[str], threshold: float = MAJOR_DROP) -> TailRisk:
    return fit_tail_risks(train, cols, threshold=threshold)[None]


def predict_tail_risk(df: DataFrame, m: TailRisk) -> DataFrame:
    p = m.classifier.probability() if m.classifier else F.lit(float(m.constant_probability))
    mag = m.magnitude.linear() if m.magnitude else F.lit(float(m.fallback_magnitude))
    out = df.withColumns({"p_major_drop": p, "expected_drop_magnitude": mag})
    return out.withColumn(
        "tail_risk_score", F.col("p_major_drop") * -F.least(F.col("expected_drop_magnitude"), F.lit(0.0))
    )


@dataclass
class ConditionalCar:
    failure: LinearScore | None
    success: LinearScore | None
    failure_mean: float
    success_mean: float


def _conditional_parts() -> dict[str, Column]:
    y, car = F.col("clinical_failure"), F.col("realized_car").isNotNull()
    return {"1": (y == 1) & car, "0": (y == 0) & car}


def _conditional_car(found: Fitted, cols: Sequence[str], end: int | None) -> ConditionalCar:
    ridge = {k: found.ridge((k, end), SHORT_ALPHA, cols) if found.count((k, end)) >= MIN_SHORT_ROWS else None for k in "10"}
    f, s = found.target_mean(("1", end)), found.target_mean(("0", end))
    return ConditionalCar(ridge["1"], ridge["0"], SHORT_FAILURE_DEFAULT if f is None else f, SHORT_SUCCESS_DEFAULT if s is None else s)


def fit_conditional_car(train: DataFrame, cols: Sequence[str]) -> ConditionalCar:
    parts = _conditional_parts()
    return _conditional_car(statistics(train, cols, parts, [(p, None) for p in parts], "realized_car"), cols, None)


def conditional_columns(m: ConditionalCar) -> tuple[Column, Column]:
    """(failure CAR, success CAR); a fitted failure model never predicts a gain."""
    f = F.least(m.failure.linear(), F.lit(0.0)) if m.failure else F.lit(float(m.failure_mean))
    s = m.success.linear() if m.success else F.lit(float(m.success_mean))
    return f, s


def _inner_years(years: Sequence[int], end: int) -> list[int]:
    """The last three training years of a window, which its threshold is judged on; none if there are fewer."""
    known = [y for y in sorted(years) if y <= end]
    return known[-3:] if len(known) >= 3 else []


def nested_thresholds(
    frame: DataFrame, tails: dict[int | None, TailRisk], ends: Sequence[int], years: Sequence[int], year: str = "catalyst_year"
) -> dict[int, float]:
    """Per training window, the P(drop) threshold with the best mean short return over its last three years.

    `tails` holds the tail model of the window before each of these years. Windows share inner years, so each year is scored
    once, at all thresholds, in one pass for all windows. The smallest threshold wins ties.
    """
    inner = sorted({y for e in ends for y in _inner_years(years, e)})
    usable = {y: tails[y - 1] for y in inner if tails[y - 1].n_rows >= MIN_SHORT_TRAIN and tails[y - 1].n_drops >= 2}
    means: dict[int, list[float | None]] = {}
    if usable:
        scored = with_tail_probability(frame, year, usable)
        short = sc.short_return(F.col("realized_car"))
        aggs = [F.avg(F.when(F.col("p_major_drop") >= t, short)).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)]
        means = {r[year]: [r[f"t{i}"] for i in range(len(THRESHOLDS))] for r in scored.groupBy(year).agg(*aggs).collect()}
    out = {}
    for e in ends:
        mine = _inner_years(years, e)
        per_t = [[means[y][i] for y in mine if y in means and means[y][i] is not None] for i in range(len(THRESHOLDS))]
        scores = [(sum(v) / len(v), -t) for v, t in zip(per_t, THRESHOLDS, strict=True) if v]
        out[e] = CONFIG_THRESHOLD if not mine else -max(scores)[1] if scores else THRESHOLDS[0]
    return out


def with_tail_probability(frame: DataFrame, year: str, tails: dict[int, TailRisk]) -> DataFrame:
    """`p_major_drop` and `expected_drop_magnitude` of each row by the tail model of its year, in one pass."""
    scores = {
        y: {
            "_drop_linear": t.classifier, "_drop_rate": None if t.classifier else t.constant_probability,
            "expected_drop_magnitude": t.magnitude if t.magnitude else t.fallback_magnitude,
        }
        for y, t in tails.items()
    }
    out = scored_by_year(frame, year, scores)
    return out.withColumn("p_major_drop", F.coalesce("_drop_rate", _sigmoid(F.col("_drop_linear")))).drop("_drop_rate", "_drop_linear")


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fold_years(df: DataFrame, first_train_end: int, step: int, minimum: int, year: str = "catalyst_year") -> tuple[dict[int, int], list[int]]:
    """(train_end -> test_year of an expanding walk-forward, all years); thin or empty folds are skipped. One count per year."""
    counts = {r[0]: r[1] for r in df.where(f"{year} is not null").groupBy(year).count().collect()}
    out, end = {}, first_train_end
    while counts and end < max(counts):
        if sum(c for y, c in counts.items() if y <= end) >= minimum and counts.get(end + step, 0):
            out[end] = end + step
        end += step
    if not out:
        raise ValueError("no usable fold")
    return out, sorted(counts)


def walk_forward(
    frame: DataFrame, p_cols: Sequence[str], car_cols: Sequence[str], first_train_end: int, step: int = 1,
    keep: Sequence[str] = ("catalyst_id", "ticker", "clinical_success", "realized_car", "company_dependency"), year: str = "catalyst_year",
) -> DataFrame:
    """Out-of-sample expected CAR per test year. All windows are fitted together and all test rows are scored in one pass.
    `frame` should be materialised: every pass reads it."""
    plan, _ = fold_years(frame, first_train_end, step, MIN_TRAIN, year)
    models = fit_expected_cars(frame, p_cols, car_cols, list(plan), year)
    return ledger(frame, {test: (end, models[end]) for end, test in plan.items()}, keep, year)


def ledger(frame: DataFrame, models: dict[int, tuple[int, ExpectedCar]], keep: Sequence[str], year: str = "catalyst_year") -> DataFrame:
    """Rows of each test year scored by its (train_end, model)."""
    scores = {
        test: {
            "_p": m.p_success, "_s": m.success if m.success else m.success_mean, "_f": m.failure if m.failure else m.failure_mean, "_end": float(end),
        }
        for test, (end, m) in models.items()
    }
    p, dep = _sigmoid(F.col("_p")), F.coalesce("company_dependency", F.lit(0.9))
    end = F.col("_end").cast("int")
    expected = p * F.col("_s") + (1 - p) * F.col("_f")
    return scored_by_year(frame, year, scores).select(
        *keep, p.alias("p_success"), expected.alias("expected_car"), (expected * dep).alias("expected_car_adj"),
        end.alias("train_end_year"), F.col(year).cast("int").alias("test_year"), F.concat(F.lit("expected_car_wf_"), end).alias("model_version"),
    )


def short_walk_forward(
    frame: DataFrame, p_cols: Sequence[str], car_cols: Sequence[str], first_train_end: int, step: int = 1,
    locked_from: str | None = LOCKED_FROM, year: str = "catalyst_year",
) -> DataFrame:
    """Out-of-sample failure, conditional-return and tail predictions with costs applied; see `short_walk_forwards`."""
    return short_walk_forwards(frame, {"": (p_cols, car_cols)}, first_train_end, step, locked_from, year)[""]


def short_walk_forwards(
    frame: DataFrame, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], first_train_end: int, step: int = 1,
    locked_from: str | None = LOCKED_FROM, year: str = "catalyst_year",
) -> dict[str, DataFrame]:
    """The short ledger of every feature set (failure and tail columns, conditional-return columns). Rows announced on or after
    `locked_from`, or without a date, are neither trained nor tested on; None locks nothing.

    Windows of the folds and of the inner threshold years, and all sets, share two passes of sums over the union of columns; all
    failure and tail classifiers share the Newton passes. `frame` should be materialised.
    """
    if locked_from is not None:
        frame = frame.filter(before_locked_holdout("announcement_date", locked_from))
    plan, years = fold_years(frame, first_train_end, step, MIN_SHORT_TRAIN, year)
    ends = list(plan)
    tail_ends = sorted({*ends, *(y - 1 for e in ends for y in _inner_years(years, e))})
    parts = {**_tail_parts(MAJOR_DROP), **_conditional_parts(), "p": F.col("clinical_failure").isNotNull()}
    keys = [(p, e) for p in ("all", "drop") for e in tail_ends] + [(p, e) for p in ("1", "0", "p") for e in ends]
    union = [c for p_cols, car_cols in sets.values() for c in (*p_cols, *car_cols)]
    found = statistics(frame, union, parts, keys, "realized_car", year)
    fits: dict[tuple, Logistic] = {}
    for name, (p_cols, _) in sets.items():
        fits |= {(name, "tail", e): Logistic(("all", e), "_drop", found.scaler(("all", e), p_cols)) for e in tail_ends}
        fits |= {(name, "failure", e): Logistic(("p", e), "clinical_failure", found.scaler(("p", e), p_cols)) for e in ends}
    fitted = logistic_fits(_flagged(frame, MAJOR_DROP), fits, parts, year)
    out = {}
    for name, (p_cols, car_cols) in sets.items():
        if any((name, "failure", e) not in fitted for e in ends):
            raise ValueError("logistic fit needs both classes")
        tails = {e: _tail_risk(found, fitted.get((name, "tail", e)), p_cols, e, MAJOR_DROP) for e in tail_ends}
        thresholds = nested_thresholds(frame, tails, ends, years, year)
        scores = {}
        for end, test in plan.items():
            m = _conditional_car(found, car_cols, end)
            scores[test] = {
                "_p": fitted[name, "failure", end], "_f": m.failure if m.failure else m.failure_mean, "_cap": 0.0 if m.failure else None,
                "_s": m.success if m.success else m.success_mean, "_end": float(end), "_t": thresholds[end],
            }
        out[name] = _short_ledger(frame, scores, {test: tails[end] for end, test in plan.items()}, year)
    return out


def _short_ledger(frame: DataFrame, scores: dict[int, dict], tails: dict[int, TailRisk], year: str) -> DataFrame:
    rows = with_tail_probability(scored_by_year(frame, year, scores), year, tails)
    end = F.col("_end").cast("int")
    out = rows.withColumns({
        # a fitted failure model never predicts a gain; least() skips the missing cap of a constant
        "p_failure": _sigmoid(F.col("_p")), "car_failure_pred": F.least("_f", "_cap"), "car_success_pred": F.col("_s"),
        "tail_risk_score": F.col("p_major_drop") * -F.least(F.col("expected_drop_magnitude"), F.lit(0.0)),
    }).withColumn("expected_car", sc.expected_car(F.col("p_failure"), F.col("car_failure_pred"), F.col("car_success_pred"), F.col("company_dependency")))
    return out.select(
        "catalyst_id", "ticker", "announcement_date", "catalyst_year", end.alias("train_end_year"), F.col(year).cast("int").alias("test_year"),
        "p_failure", (1 - F.col("p_failure")).alias("p_success"), "car_failure_pred", "car_success_pred",
        "expected_car", (-F.col("expected_car")).alias("expected_short_return"), sc.short_return(F.col("expected_car")).alias("net_expected_short_return"),
        "p_major_drop", "tail_risk_score", F.col("_t").alias("major_drop_threshold"), "company_dependency", "realized_car",
        sc.short_return(F.col("realized_car")).alias("realized_short_return"), "clinical_failure", "major_negative_event",
        F.concat(F.lit("short_wf_"), end).alias("model_version"),
    )


def require_provenance(m: ExpectedCar | None) -> ExpectedCar:
    """Ranking refuses a missing model or one trained without point-in-time sanitised features."""
    if m is None:
        raise FileNotFoundError("no expected-CAR model; refusing to rank with realised outcomes")
    if m.policy != PROVENANCE:
        raise ValueError("model lacks strict point-in-time training provenance; retrain it")
    return m
