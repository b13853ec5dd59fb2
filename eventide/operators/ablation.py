"""Feature-set ablations: every set is fitted from the passes of their union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import metrics, models, trades
from eventide.operators.windows import Logistic, logistic_fits, statistics

# Feature sets that are compared, in sample and out of sample.
EXPECTED_CAR_SETS = ("market_only", "market_plus_trial", "market_plus_preclinical", "market_plus_trial_plus_preclinical")
SHORT_SETS = (
    "company_only", "market_only", "clinical_only", "preclinical_only", "market_plus_company", "clinical_plus_market",
    "everything_no_preclinical", "everything",
)
SHORT_STRATEGIES = ("short_top_20pct", "short_top_10pct")


def expected_car_models(train: DataFrame, sets: Mapping[str, Sequence[str]], car_cols: Sequence[str]) -> dict[str, models.ExpectedCar]:
    """One model per set of success features. Medians, scalers and return models come from the Gram matrices of the union of
    columns, and the success models of all sets take their Newton steps together. `train` should be materialised."""
    parts = models.expected_parts()
    union = list(dict.fromkeys([*(c for cols in sets.values() for c in cols), *car_cols]))
    found = statistics(train, union, parts, [(p, None) for p in parts], "realized_car")
    fits = {name: Logistic(("p", None), "clinical_success", found.scaler(("p", None), cols)) for name, cols in sets.items()}
    p_models = logistic_fits(train, fits, parts)
    if len(p_models) < len(sets):
        raise ValueError("logistic fit needs both classes")
    return {name: models.expected_car_of(found, p_models[name], car_cols, None) for name in sets}


def scored_sets(df: DataFrame, fitted: Mapping[str, models.ExpectedCar], keep: Sequence[str]) -> DataFrame:
    """`keep`, model, p_success and expected_car: each row once per model, all models in one pass."""
    each = []
    for name, m in fitted.items():
        p, e = models.expected_car_columns(m)
        each.append(F.struct(F.lit(name).alias("model"), p.alias("p_success"), e.alias("expected_car")))
    return df.select(*keep, F.explode(F.array(*each)).alias("_m")).select(*keep, "_m.*")


def summary(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows, correlation and means of expected and realised CAR per group."""
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), metrics.correlation("expected_car", "realized_car").alias("corr"),
        F.avg("expected_car").alias("mean_expected"), F.avg("realized_car").alias("mean_realized"),
    )


def short_ablation(frame: DataFrame, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], first_train_end: int, **options) -> DataFrame:
    """Out-of-sample short strategies per feature set: trades, mean short return, hit rate and worst return.

    All sets and windows are fitted together; each set's ledger is one pass over the frame.
    """
    ledgers = models.short_walk_forwards(frame, sets, first_train_end, **options)
    parts = []
    for name, ledger in ledgers.items():
        traded = trades.model_strategies(ledger, "net_expected_short_return").filter(F.col("strategy").isin(*SHORT_STRATEGIES))
        parts.append(traded.select(F.lit(name).alias("feature_set"), "strategy", "realized_short_return"))
    r = F.col("realized_short_return")
    return reduce(DataFrame.unionByName, parts).groupBy("feature_set", "strategy").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean_short_return"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.min(r).alias("worst"),
    )
