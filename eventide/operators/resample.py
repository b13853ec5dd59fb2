"""Deterministic resampling: bootstrap, block bootstrap and sign permutation.

Draws come from a counter-based mix of (seed, replicate, row id) in plain 64-bit integer arithmetic, so any engine reproduces
them at any size. The bootstrap gives each row an independent Poisson(1) weight per replicate, its usual form at scale: no row is
numbered, moved or repeated; each task adds its rows to one array of replicate sums per group.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.ordered import quantiles
from eventide.session import stable

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A prime modulus and odd multipliers of the mix.
PRIME = 2147483647
# Cumulative probabilities of a Poisson(1) variable.
POISSON_CDF = (
    0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846,
    0.996340153172656, 0.999405815182418, 0.999916758850712, 0.999989750803325,
)


#: Values are summed as whole multiples of 2^-SCALE, split in a high and a low part of LOW bits.
SCALE, LOW = 40, 30
_CELLS = 1 << 16
_GROUPS = 2048


def with_draw(df: DataFrame, seed: int, replicate: str, position: str, out: str) -> DataFrame:
    """Add a pseudo-random integer in [0, PRIME). The steps stay separate projections so that no
    intermediate value is evaluated twice."""
    i, b = F.col(position).cast("long"), F.col(replicate).cast("long")
    return (
        df.withColumn("_u0", (i * 48271 + b * 69621 + (seed * 16807 + 12345)) % PRIME)
        .withColumn("_u1", (F.col("_u0") * F.col("_u0") + i + 7) % PRIME)
        .withColumn("_u2", (F.col("_u1") * F.col("_u1") + b * 7919 + 1) % PRIME)
        .withColumn(out, (F.col("_u2") * F.col("_u2") + F.col("_u0")) % PRIME)
        .drop("_u0", "_u1", "_u2")
    )


#: Below it no step of a draw leaves 63 bits.
_SMALL = 1 << 40


def _folded(x: np.ndarray) -> np.ndarray:
    """The same residue of PRIME = 2^31 - 1, from numbers of up to 63 bits one of at most 33, from such a one of at most PRIME + 3."""
    high = x >> 31
    x &= PRIME
    x += high
    return x


def draws(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """ids x replicates, the same integers as `with_draw`."""
    i, b = ids.astype(np.int64)[:, None], replicates.astype(np.int64)
    if i.size and b.size and i.min() >= 0 and i.max() < _SMALL and b.min() >= 0 and b.max() < _SMALL and 0 <= seed < _SMALL:
        u0 = _folded((i * 48271 + (seed * 16807 + 12345)) % PRIME + b * 69621 % PRIME)
        u1 = _folded(_folded(u0 * u0 + (i + 7) % PRIME))
        u2 = _folded(_folded(np.square(u1, out=u1) + (b * 7919 + 1) % PRIME))
        d = _folded(_folded(np.add(np.square(u2, out=u2), u0, out=u2)))
        d -= (d >= PRIME) * np.int64(PRIME)
        return d
    u0 = np.fmod(i * 48271 + b * 69621 + (seed * 16807 + 12345), PRIME)
    u1 = np.fmod(u0 * u0 + i + 7, PRIME)
    u2 = np.fmod(u1 * u1 + b * 7919 + 1, PRIME)
    return np.fmod(u2 * u2 + u0, PRIME)


def _first_at_least(share: float) -> int:
    """The least draw d with d / PRIME >= share."""
    d = int(share * PRIME)
    while d / PRIME >= share:
        d -= 1
    while d / PRIME < share:
        d += 1
    return d


POISSON_AT = tuple(_first_at_least(c) for c in POISSON_CDF)


def poisson_of(d: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of draws."""
    n = np.zeros(d.shape, np.uint8)
    for c in POISSON_AT:
        n += d >= c
    return n.astype(np.float64)


def sign_of(d: np.ndarray) -> np.ndarray:
    return np.where(d % 2 == 0, 1.0, -1.0)


def replicate_sums(
    df: DataFrame, values: Sequence[str], id_col: str, group: Sequence[str], n_boot: int, seed: int, weights: Callable[[np.ndarray], np.ndarray] = poisson_of,
) -> DataFrame:
    """(group, b, n, hi0, lo0, hi1, ...): per group and replicate the sum of weights and, per value, the exact sum of weight times
    floor(value * 2^SCALE), as hi * 2^LOW + lo.

    A task keeps one array of n_boot partial sums per group and updates it in place, so what is shuffled depends on tasks, groups and
    replicates, not on rows, and no row is repeated. Sums are whole numbers: they do not depend on the order of rows. Values must lie
    within +-2^22. Rows with a null id or value are left out; `id_col` is an integer key, rows that share an id share their weights.
    """
    names = [f"{part}{k}" for k in range(len(values)) for part in ("hi", "lo")]
    g = len(group)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicates = np.arange(n_boot)
        code: dict[tuple, int] = {}
        sums: list[np.ndarray] = []
        kinds = None

        def flush() -> pa.RecordBatch:
            keys = list(code)
            columns = [pa.array([k[i] for k in keys for _ in range(n_boot)], kinds[i]) for i in range(g)]
            each = np.concatenate(sums, axis=1)  # (1 + 2 values) x (groups * n_boot)
            columns += [pa.array(np.tile(replicates, len(keys))), *(pa.array(row) for row in each)]
            return pa.RecordBatch.from_arrays(columns, [*group, "b", "n", *names])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(g)]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(g)), strict=True)) if g else [()] * batch.num_rows
            ids = batch.column(g).to_numpy()
            fixed = np.stack([np.floor(np.ldexp(batch.column(g + 1 + k).to_numpy(), SCALE)).astype(np.int64) for k in range(len(values))], axis=1)
            parts = np.stack([part for k in range(len(values)) for part in (fixed[:, k] >> LOW, fixed[:, k] & ((1 << LOW) - 1))], axis=1).astype(np.float64)
            parts = np.hstack([np.ones((len(ids), 1)), parts])
            of = np.array([code.setdefault(k, len(code)) for k in keys], np.int64)
            while len(sums) < len(code):
                sums.append(np.zeros((parts.shape[1], n_boot), np.int64))
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            step = max(1, min(512, _CELLS // n_boot))
            for rows in np.split(order, cuts):
                for first in range(0, len(rows), step):
                    some = rows[first : first + step]
                    # below 2^53, so the products of doubles are exact
                    sums[of[some[0]]] += (parts[some].T @ weights(draws(ids[some], replicates, seed))).astype(np.int64)
            if len(code) > _GROUPS:
                yield flush()
                code.clear()
                sums.clear()
        if code:
            yield flush()

    kept = df.select(*group, F.col(id_col).cast("long").alias("_id"), *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)])
    kept = kept.filter(reduce(lambda a, b: a & b, [F.col("_id").isNotNull(), *(F.col(f"_v{k}").isNotNull() for k in range(len(values)))]))
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group), "b long, n long", *(f"{c} long" for c in names)])
    return kept.mapInArrow(read, kinds).groupBy(*group, "b").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def _total(k: int) -> Column:
    """The k-th sum as a double, rounded once."""
    return (F.col(f"hi{k}").cast("double") * float(1 << LOW) + F.col(f"lo{k}").cast("double")) / float(1 << SCALE)


def _replicates(n_boot: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))


def bootstrap_means(
    df: DataFrame, value: str, id_col: str, group: Sequence[str] = (), n_boot: int = 500, seed: int = 42
) -> DataFrame:
    """(group, b, mean): bootstrap means of `value` per group. A replicate that draws no row of a group has none."""
    return means_of(replicate_sums(df, [value], id_col, group, n_boot, seed), group)


def means_of(sums: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, b, mean) of the first value of `replicate_sums`."""
    return sums.filter("n > 0").select(*group, "b", (_total(0) / F.col("n")).alias("mean"))


def interval(means: DataFrame, group: Sequence[str] = (), value: str = "mean") -> DataFrame:
    """2.5 and 97.5 percentiles and the share of positive values; at most n_boot values per group."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*group).agg(
        q[0].alias("ci_lo"),
        q[1].alias("ci_hi"),
        F.avg((F.col(value) > 0).cast("double")).alias("p_positive"),
        F.avg((F.col(value) <= 0).cast("double")).alias("p_value"),
    )


def bootstrap_correlations(
    df: DataFrame, x: str, y: str, id_col: str, n_boot: int = 500, seed: int = 42
) -> DataFrame:
    """(b, mean): bootstrap correlations; replicates without variance are dropped."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    products = {"_a": a, "_b": b, "_ab": a * b, "_aa": a * a, "_bb": b * b}
    sums = replicate_sums(df.select(id_col, *[c.alias(n) for n, c in products.items()]), list(products), id_col, [], n_boot, seed)
    sums = sums.select("b", "n", *[_total(k).alias(n) for k, n in enumerate(("sx", "sy", "sxy", "sxx", "syy"))])
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    usable = sums.filter((F.col("n") >= 3) & (vx > 1e-12) & (vy > 1e-12))
    return usable.select("b", (cov / F.sqrt(vx * vy)).alias("mean"))


def sign_permutation(df: DataFrame, value: str, id_col: str, n_perm: int = 2000, seed: int = 42) -> DataFrame:
    """Share of sign-flipped sums at least as large as the observed sum; whole numbers are compared, so ties are ties."""
    flipped = replicate_sums(df, [value], id_col, [], n_perm, seed, sign_of)
    plain = replicate_sums(df, [value], id_col, [], 1, seed, np.ones_like)

    def whole(sums: DataFrame) -> Column:
        return F.col("hi0").cast("decimal(38,0)") * F.lit(1 << LOW).cast("decimal(19,0)") + F.col("lo0").cast("decimal(38,0)")

    observed = plain.select(whole(plain)).scalar()
    return flipped.agg(F.avg((whole(flipped) >= observed).cast("double")).alias("permutation_p"))


def block_bootstrap(
    df: DataFrame, value: str, block: str, n_boot: int = 2000, seed: int = 42
) -> DataFrame:
    """(b, mean): whole years drawn with replacement. Only each year's sum and count are needed, so
    the drawn table holds one row per year."""
    years = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    w = Window.partitionBy(F.lit(0))
    numbered_years = stable(
        years.select(
            (F.row_number().over(w.orderBy(block)) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"), "s", "c"
        )
    )
    slots = numbered_years.select("n", "pos", _replicates(n_boot).alias("b"))
    slots = with_draw(slots, seed, "b", "pos", "_d").select("b", (F.col("_d") % F.col("n")).alias("pos"))
    drawn = slots.join(F.broadcast(numbered_years.select("pos", "s", "c")), "pos")
    return drawn.groupBy("b").agg((F.sum("s") / F.sum("c")).alias("mean"))


def residual_intervals(preds: DataFrame, residuals: DataFrame, id_col: str, estimate: str, residual: str) -> DataFrame:
    """(id, lo, hi): estimate plus the 2.5/97.5 percentiles of resampled residuals, for every prediction.

    Residuals are drawn alike for each row, so the percentiles of unboundedly many draws are those of the residuals
    themselves: they are taken once, exactly, and no row is expanded. Without residuals both ends are the estimate.
    """
    q = stable(quantiles(residuals.filter(F.col(residual).isNotNull()), [], residual, {"lo": 0.025, "hi": 0.975}))
    end = {c: F.col(estimate) + F.coalesce(q.select(c).scalar(), F.lit(0.0)) for c in ("lo", "hi")}
    return preds.select(id_col, *[e.alias(c) for c, e in end.items()])
