"""As-of joins.

Both sides are first collapsed to one row per (key, date) with combinable aggregates, then merged
in one ordered pass per key. The calendar bounds every group whatever the skew of the raw rows,
and the raw left rows come back by an equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timeline(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str):
    probes = left.select(key, F.col(left_date).alias("_d")).where("_d is not null").distinct()
    marks = right.select(key, F.col(right_date).alias("_d")).where("_d is not null").distinct()
    return probes, marks


def forward_session(
    left: DataFrame, sessions: DataFrame, key: str, left_date: str, session_date: str, out: str
) -> DataFrame:
    """First session on or after `left_date`, null when there is none."""
    probes, marks = _timeline(left, sessions, key, left_date, session_date)
    line = probes.select(key, "_d", F.lit(None).cast("date").alias("_s"), F.lit(1).alias("_probe"))
    line = line.unionByName(marks.select(key, "_d", F.col("_d").alias("_s"), F.lit(0).alias("_probe")))
    w = Window.partitionBy(key).orderBy(F.col("_d").desc(), F.col("_probe").asc())
    hit = F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = line.select(key, "_d", "_probe", hit.alias(out)).filter("_probe = 1").drop("_probe")
    return left.join(found.withColumnRenamed("_d", left_date), [key, left_date], "left")


def nearest_session(
    left: DataFrame, sessions: DataFrame, key: str, left_date: str, session_date: str, out: str
) -> DataFrame:
    """Closest session on either side; the later one wins a tie."""
    probes, marks = _timeline(left, sessions, key, left_date, session_date)
    line = probes.select(key, "_d", F.lit(None).cast("date").alias("_s"), F.lit(1).alias("_probe"))
    line = line.unionByName(marks.select(key, "_d", F.col("_d").alias("_s"), F.lit(0).alias("_probe")))
    down = Window.partitionBy(key).orderBy(F.col("_d").desc(), F.col("_probe").asc())
    up = Window.partitionBy(key).orderBy(F.col("_d").asc(), F.col("_probe").asc())
    span = (Window.unboundedPreceding, Window.currentRow)
    both = line.withColumns(
        {"_next": F.min("_s").over(down.rowsBetween(*span)), "_prev": F.max("_s").over(up.rowsBetween(*span))}
    ).filter("_probe = 1")
    near = (
        F.when(F.col("_next").isNull(), F.col("_prev"))
        .when(F.col("_prev").isNull(), F.col("_next"))
        .when(
            F.datediff(F.col("_next"), F.col("_d")) <= F.datediff(F.col("_d"), F.col("_prev")),
            F.col("_next"),
        )
        .otherwise(F.col("_prev"))
    )
    found = both.select(key, F.col("_d").alias(left_date), near.alias(out))
    return left.join(found, [key, left_date], "left")


def backward_state(
    left: DataFrame,
    facts: DataFrame,
    keys: list[str],
    left_date: str,
    known_date: str,
    priority: Column,
    payload: list[str],
    out: str,
    strict: bool = False,
) -> DataFrame:
    """Best fact known by `left_date` per key: the highest `priority` among `known_date <= left_date`
    (or `<` when strict). `out` is a struct of the payload, null when nothing was known yet."""
    probes = left.select(*keys, F.col(left_date).alias("_d")).where("_d is not null").distinct()
    best = F.max(F.struct(priority.alias("p"), F.struct(*payload).alias("v")))
    known = (
        facts.where(F.col(known_date).isNotNull())
        .groupBy(*keys, F.col(known_date).alias("_d"))
        .agg(best.alias("_f"))
    )
    line = known.select(*keys, "_d", "_f", F.lit(1 if strict else 0).alias("_seq")).unionByName(
        probes.select(*keys, "_d", F.lit(0 if strict else 1).alias("_seq")),
        allowMissingColumns=True,
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy("_d", "_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    probe_seq = 0 if strict else 1
    found = (
        line.withColumn("_best", F.max("_f").over(w))
        .filter(F.col("_seq") == probe_seq)
        .select(*keys, F.col("_d").alias(left_date), F.col("_best.v").alias(out))
    )
    return left.join(found, [*keys, left_date], "left")
