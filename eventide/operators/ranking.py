"""Ranking of candidates: prospective rows only unless asked, intervals from the best residuals there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators import metrics, models
from eventide.operators.ordered import numbered, percent_ranks
from eventide.session import staging_path

DEFAULT_DEPENDENCY = 0.9


def export_residuals(walk_forward: DataFrame, path: str | None = None, id_col: str = "catalyst_id") -> DataFrame:
    """Write the out-of-sample residuals of a walk-forward (raw expected CAR, before exposure) and read them back: (id, residual).
    `path` defaults to a fresh staged table; a later ranking reads it without running the walk-forward again."""
    spark = walk_forward.sparkSession
    path = path or staging_path(spark, "oos_residuals")
    rows = walk_forward.select(F.col(id_col).alias("id"), (F.col("realized_car") - F.col("expected_car")).alias("residual"))
    rows.filter("residual is not null").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def candidates(frame: DataFrame, as_of: str | None, include_historical: bool = False) -> DataFrame:
    """Rows to rank: announced on or after `as_of`, or without a date; all of them only on explicit request."""
    if include_historical:
        return frame
    if as_of is None:
        raise ValueError("a prospective ranking needs its date")
    day = F.col("announcement_date")
    return frame.filter(day.isNull() | (day >= F.lit(as_of).cast("date")))


def rank(
    frame: DataFrame, model: models.ExpectedCar | None, residuals: Sequence[tuple[str, DataFrame]], as_of: str | None, include_historical: bool = False,
) -> DataFrame:
    """Rank, exposure-adjusted interval, percentile signal and confidence signal of the candidates.

    `residuals` lists (source, (id, residual)) by preference, for example export, ledger, in-sample: the first with ten or more is
    used, the last needs none. A missing model, or one without point-in-time provenance, is refused.
    """
    model = models.require_provenance(model)
    pred = models.predict_expected_car(candidates(frame, as_of, include_historical), model)
    picked = metrics.pick_residuals(list(residuals))
    q = metrics.conformal_quantile(picked, "residual").select("q").scalar()
    source = picked.agg(F.min("source")).scalar()
    dep = F.coalesce("company_dependency", F.lit(DEFAULT_DEPENDENCY))
    adj = pred.withColumns({"_q": q, "interval_source": source, "_dep": dep, "expected_car_exposure_adj": F.col("expected_car") * dep})
    pct = percent_ranks(adj, [], "expected_car_exposure_adj", "pct")
    ranked = numbered(pct, [], [F.col("expected_car_exposure_adj").desc(), F.col("catalyst_id").asc()], "rank")
    lo, hi = ((F.col("expected_car") + s * F.col("_q")) * F.col("_dep") for s in (-1, 1))
    return ranked.withColumns({
        "lo": lo, "hi": hi, "signal": sc.percentile_signal(F.col("pct")), "confidence_signal": sc.confidence_signal(lo, hi),
        "model_training_policy": F.lit(model.policy),
    }).drop("_q", "_dep", "pct")
