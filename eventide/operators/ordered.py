"""Order-dependent operators over groups of any size.

A plain window sends a whole group to one task. Here rows are range-partitioned on (group, order),
numbered or summed inside each range, and shifted by the totals of the ranges before it. A group
that holds a third of all rows is spread over a third of the ranges; the only thing gathered per
group is one total per range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import stable

_RANGE = "_range_id"


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums and maxima per group.

    `sums` and `maxes` map new column names to input columns. With `totals`, each sum `s` also gets
    its whole-group total as `s_total`. Group columns must not be null; `order` must be total.
    """
    sums, maxes = sums or {}, maxes or {}
    group = list(group)
    keys = [F.col(g) for g in group]
    order_cols = _order(order)
    ranged = stable(
        df.repartitionByRange(*keys, *order_cols).withColumn(_RANGE, F.spark_partition_id())
    )
    local_w = (
        Window.partitionBy(_RANGE, *group)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select(
        "*",
        *[F.sum(src).over(local_w).alias(out) for out, src in sums.items()],
        *[F.max(src).over(local_w).alias(out) for out, src in maxes.items()],
    )
    per_range = ranged.groupBy(_RANGE, *group).agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()],
        *[F.max(src).alias(f"_t_{out}") for out, src in maxes.items()],
    )
    range_w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = range_w.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select(
        _RANGE,
        *group,
        *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in sums],
        *[F.max(f"_t_{o}").over(before).alias(f"_b_{o}") for o in maxes],
        *([F.sum(f"_t_{o}").over(range_w).alias(f"{o}_total") for o in sums] if totals else []),
    )
    joined = local.join(shifts, [_RANGE, *group])
    out = joined.withColumns(
        {
            **{o: F.col(o) + F.coalesce(F.col(f"_b_{o}"), F.lit(0)) for o in sums},
            **{o: F.greatest(F.col(o), F.col(f"_b_{o}")) for o in maxes},
        }
    )
    return out.drop(_RANGE, *[f"_b_{o}" for o in (*sums, *maxes)])


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "row_no",
    totals: bool = False,
) -> DataFrame:
    """1-based row number inside each group (and the group size as `<name>_total`)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, group, order, sums={name: "_one"}, totals=totals).drop("_one")


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    positions: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Values at 0-based positions of the sorted non-null values; `positions` maps name → f(n)."""
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_cnt")
    )
    cum = running(counts, group, [value], sums={"_cum": "_cnt"}, totals=True)
    n = F.col("_cum_total")
    hit = [
        F.max(
            F.when(
                (pos(n) >= F.col("_cum") - F.col("_cnt")) & (pos(n) < F.col("_cum")), F.col(value)
            )
        ).alias(name)
        for name, pos in positions.items()
    ]
    return cum.groupBy(*group).agg(F.max("_cum_total").alias("n_values"), *hit)


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of `probs`."""

    def at(p: float, side: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda n: side(F.lit(float(p)) * (n - 1)).cast("long")

    positions: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        positions[f"_lo_{name}"] = at(p, F.floor)
        positions[f"_hi_{name}"] = at(p, F.ceil)
    stats = order_statistics(df, group, value, positions)
    out = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("n_values") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return stats.select(*group, "n_values", *out)


def percent_ranks(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Average-of-ties rank divided by the number of non-null values; null values rank null.

    Ranks are computed once per distinct value, so repeated values never pile up in one task.
    """
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_cnt")
    )
    cum = running(counts, group, [value], sums={"_cum": "_cnt"}, totals=True)
    pct = (F.col("_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / F.lit(2.0)) / F.col("_cum_total")
    ranks = cum.select(*group, value, pct.alias(name))
    return df.join(ranks, [*group, value], "left")
