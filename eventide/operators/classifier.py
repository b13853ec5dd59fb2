"""Program classifier: imputed and scaled numbers, one-hot categories, balanced logistic, isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators import models
from eventide.operators.windows import Scaler

MIN_CALIBRATION = 3


@dataclass
class Classifier:
    categories: dict[str, tuple[str, list[str]]]
    score: models.LinearScore
    calibrator: IsotonicRegressionModel | None


def _modes(df: DataFrame, cats: Sequence[str]) -> dict[str, tuple[str, list[str]]]:
    """Most frequent value and sorted levels per category. Levels become columns, so their number is the
    model's width by design."""
    out = {}
    for c in cats:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).collect()
        out[c] = (counts[0][0] if counts else "", sorted(r[0] for r in counts))
    return out


def _one_hot(df: DataFrame, categories: dict[str, tuple[str, list[str]]]) -> tuple[DataFrame, list[str]]:
    """0/1 columns; missing values take the most frequent level, unseen levels are all zero."""
    cols = {}
    for c, (mode, levels) in categories.items():
        value = F.coalesce(F.col(c), F.lit(mode))
        cols |= {f"{c}_is_{i}": (value == lv).cast("double") for i, lv in enumerate(levels)}
    return df.withColumns(cols), list(cols)


def fit(train: DataFrame, validation: DataFrame | None, nums: Sequence[str], cats: Sequence[str], label: str) -> Classifier:
    categories = _modes(train, cats)
    hot, names = _one_hot(train, categories)
    rows = hot.filter(F.col(label).isNotNull())
    # numbers are imputed and scaled, 0/1 columns stay as they are
    of_nums = models.fit_scaler(rows, nums)
    zero, one = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    scaler = Scaler([*of_nums.cols, *names], {**of_nums.median, **zero}, {**of_nums.mean, **zero}, {**of_nums.scale, **one})
    score = models.fit_logistic(hot, scaler.cols, label, scaler=scaler)
    calibrator = None
    if validation is not None:
        n, k = validation.agg(F.count(label), F.sum(label)).first()
        if n >= MIN_CALIBRATION and 0 < (k or 0) < n:
            v, _ = _one_hot(validation, categories)
            pairs = v.select(score.probability().alias("features"), F.col(label).cast("double").alias("label"))
            calibrator = IsotonicRegression(featuresCol="features", labelCol="label").fit(pairs)
    return Classifier(categories, score, calibrator)


def score(df: DataFrame, m: Classifier, keep: Sequence[str]) -> DataFrame:
    """Raw and calibrated probability; missing features are imputed as in training."""
    hot, _ = _one_hot(df, m.categories)
    out = hot.withColumn("features", m.score.probability()).withColumn("p_raw", F.col("features"))
    if m.calibrator is not None:
        out = m.calibrator.transform(out).withColumnRenamed("prediction", "p")
    else:
        out = out.withColumn("p", F.col("p_raw"))
    return out.select(*keep, "p_raw", "p")


def cross_validate(df: DataFrame, nums: Sequence[str], cats: Sequence[str], label: str, id_col: str, k: int, fold: Column | None = None) -> DataFrame:
    """Out-of-fold probabilities; the fold is a hash of the id unless given (k = n gives leave-one-out on small frames)."""
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(k)) if fold is None else fold)
    parts = []
    for i in range(k):
        m = fit(folded.filter(F.col("_fold") != i), None, nums, cats, label)
        parts.append(score(folded.filter(F.col("_fold") == i), m, [id_col, label]))
    return reduce(DataFrame.unionByName, parts)


def ordinal_codes(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Alphabetical integer codes per category."""
    outs = [f"{c}_code" for c in cats]
    filled = df.fillna("UNKNOWN", subset=list(cats))
    indexer: StringIndexerModel = StringIndexer(
        inputCols=list(cats), outputCols=outs, stringOrderType="alphabetAsc", handleInvalid="keep").fit(filled)
    return indexer.transform(filled)


def fit_sets(
    train: DataFrame, validation: DataFrame | None, sets: dict[str, tuple[Sequence[str], Sequence[str]]], label: str
) -> tuple[dict[str, Classifier], dict[str, str]]:
    """Fit one classifier per named (numeric, categorical) feature set; a set that cannot be fitted is
    recorded with its reason and does not stop the others."""
    fitted: dict[str, Classifier] = {}
    failed: dict[str, str] = {}
    for name, (nums, cats) in sets.items():
        missing = [c for c in (*nums, *cats) if c not in train.columns]
        if missing or not (nums or cats):
            failed[name] = f"missing columns: {', '.join(missing)}" if missing else "no features"
            continue
        try:
            fitted[name] = fit(train, validation, nums, cats, label)
        except ValueError as e:
            failed[name] = str(e)
    return fitted, failed
