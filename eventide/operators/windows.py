"""Many training windows fitted together: medians, scalers, ridge and logistic fits of all of them from shared passes.

A window is all rows up to an end year that belong to a part (all rows, successes, drops, ...). Windows overlap, so fitting
them one by one reads and scales the same rows again and again. Here

* medians of all windows come from one table of distinct (column, value) with a count per window;
* scalers and ridge fits come from Gram matrices per (year, membership) that are added up over years. A matrix holds, for
  every column, the value and a flag for "missing", so that any window's imputation is a linear map of it;
* logistic fits take Newton steps together: one pass adds up gradients and Hessians of all windows.

Nothing is exploded by window, and the driver holds matrices of columns x columns per year, never rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.ordered import running

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (part, last year); None: rows of every year, also without one.
Key = tuple[str, "int | None"]
_ROWS = 4096
#: Stands for a missing year; later than any end.
_NO_YEAR = 1 << 40


@dataclass
class Scaler:
    """Median imputation and population standardisation with parameters frozen at fit time."""

    cols: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(self.median[c])) - self.mean[c]) / self.scale[c]
            for c in self.cols
        }

    def only(self, cols: Sequence[str]) -> Scaler:
        return Scaler(list(cols), *({c: d[c] for c in cols} for d in (self.median, self.mean, self.scale)))


@dataclass
class LinearScore:
    """Coefficients on the scaled features; scoring is a plain column expression."""

    scaler: Scaler
    coef: list[float]
    intercept: float

    def linear(self) -> Column:
        out = F.lit(float(self.intercept))
        for e, w in zip(self.scaler.columns().values(), self.coef, strict=True):
            out = out + e * float(w)
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.linear()))


def _members(parts: Mapping[str, Column]) -> Column:
    """Bit mask of the parts that a row belongs to."""
    out = F.lit(0).cast("long")
    for i, condition in enumerate(parts.values()):
        out = out + F.when(condition, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _within(key: Key, parts: Mapping[str, Column], year: Column, members: Column) -> Column:
    part, end = key
    inside = members.bitwiseAND(F.lit(1 << list(parts).index(part)).cast("long")) != 0
    return inside if end is None else inside & (year <= end)


def _narrow(df: DataFrame, cols: Sequence[str], parts: Mapping[str, Column], year: str | None, more: Mapping[str, Column]) -> DataFrame:
    y = F.col(year).cast("int") if year else F.lit(None).cast("int")
    return df.select(
        y.alias("_year"), _members(parts).alias("_members"), *[c.cast("double").alias(n) for n, c in more.items()],
        *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)],
    )


def medians(
    df: DataFrame, cols: Sequence[str], parts: Mapping[str, Column], keys: Sequence[Key], year: str | None
) -> tuple[dict[Key, np.ndarray], np.ndarray]:
    """Exact medians of every window's columns (NaN without values), and the mean of each column over all rows.

    Rows are exploded by column only; equal values are one row, with a count per window, before anything is ordered.
    """
    narrow = _narrow(df, cols, parts, year, {})
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_v{i}").alias("v")) for i in range(len(cols))])
    values = narrow.select("_year", "_members", F.explode(pairs).alias("p")).select("_year", "_members", "p.*").filter("v is not null and not isnan(v)")
    inside = [_within(k, parts, F.col("_year"), F.col("_members")) for k in keys]
    counts = values.groupBy("i", (F.col("v") + 0.0).alias("v")).agg(
        F.count("*").alias("_all"), *[F.count(F.when(c, 1)).alias(f"_n{w}") for w, c in enumerate(inside)]
    )
    walked = running(counts, ["i"], ["v"], sums={f"_c{w}": f"_n{w}" for w in range(len(keys))}, totals=True)
    middle = []
    for w in range(len(keys)):
        n, upto, here = F.col(f"_c{w}_total"), F.col(f"_c{w}"), F.col(f"_n{w}")
        for name, at in ((f"lo{w}", F.floor((n - 1) / 2)), (f"hi{w}", F.ceil((n - 1) / 2))):
            middle.append(F.max(F.when((at >= upto - here) & (at < upto), F.col("v"))).alias(name))
    total = (F.sum(F.col("v") * F.col("_all")) / F.sum("_all")).alias("mean")
    found = {r["i"]: r for r in walked.groupBy("i").agg(total, *middle).collect()}
    out = {k: np.full(len(cols), np.nan) for k in keys}
    mean = np.zeros(len(cols))
    for i, r in found.items():
        mean[i] = r["mean"]
        for w, k in enumerate(keys):
            if r[f"lo{w}"] is not None:
                out[k][i] = (r[f"lo{w}"] + r[f"hi{w}"]) / 2
    return out, mean


def _summed(parts: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Element-wise sums of the arrays `v` per key."""
    each = parts.select(*keys, F.posexplode("v").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    t = each.toPandas().sort_values("at")
    return {k if isinstance(k, tuple) else (k,): g["x"].to_numpy(float) for k, g in t.groupby(list(keys), dropna=False)}


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Columns from `first` on as rows x columns, null as NaN."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first, batch.num_columns)], axis=1)


@dataclass
class Fitted:
    """What all windows of a frame need: medians and added-up Gram matrices; see `statistics`."""

    cols: list[str]
    parts: list[str]
    medians: dict[Key, np.ndarray]
    shift: np.ndarray
    target_shift: float
    grams: dict[tuple, np.ndarray]

    def _gram(self, key: Key, labelled: bool) -> np.ndarray:
        part, end = key
        bit = 1 << self.parts.index(part)
        size = 2 * len(self.cols) + 2
        total = np.zeros((size, size))
        for (year, members, has_target), g in self.grams.items():
            if int(members) & bit and (end is None or year <= end) and (has_target or not labelled):
                total += g
        return total

    def _imputed(self, key: Key, labelled: bool) -> np.ndarray:
        """Gram of (1, imputed columns less their shift, target less its shift)."""
        p = len(self.cols)
        fill = np.where(np.isnan(self.medians[key]), 0.0, self.medians[key]) - self.shift
        t = np.zeros((2 * p + 2, p + 2))
        t[0, 0] = t[-1, -1] = 1.0
        t[1 + np.arange(p), 1 + np.arange(p)] = 1.0
        t[1 + p + np.arange(p), 1 + np.arange(p)] = fill
        return t.T @ self._gram(key, labelled) @ t

    def count(self, key: Key, labelled: bool = True) -> int:
        """Rows of the window, with a target or in all."""
        return round(self._gram(key, labelled)[0, 0])

    def target_mean(self, key: Key) -> float | None:
        g = self._gram(key, True)
        return float(g[0, -1] / g[0, 0] + self.target_shift) if g[0, 0] else None

    def scaler(self, key: Key, cols: Sequence[str] | None = None) -> Scaler:
        """A column without values is imputed with 0, a constant one is scaled by 1."""
        a = self._imputed(key, False)
        n = a[0, 0] or 1.0
        mean = a[0, 1:-1] / n
        sd = np.sqrt(np.maximum(np.diag(a)[1:-1] / n - mean**2, 0.0))
        size = np.maximum(np.abs(self.shift), 1.0)
        scale = np.where(sd > 1e-12 * size, sd, 1.0)
        mid = np.where(np.isnan(self.medians[key]), 0.0, self.medians[key])
        shifted = mean + self.shift if a[0, 0] else mean * 0
        full = Scaler(self.cols, *(dict(zip(self.cols, v.tolist(), strict=True)) for v in (mid, shifted, scale)))
        return full if cols is None else full.only(cols)

    def ridge(self, key: Key, alpha: float, cols: Sequence[str] | None = None, scaler: Scaler | None = None) -> LinearScore:
        """Ridge on the scaled columns with an unpenalised intercept, from the window's Gram matrix.

        `cols` picks columns: their matrix is a part of the whole one, so every feature set is solved from the same pass.
        """
        cols = list(cols or self.cols)
        scaler = scaler or self.scaler(key, cols)
        at = [self.cols.index(c) for c in cols]
        a = self._imputed(key, True)
        n = a[0, 0]
        if not n:
            return LinearScore(scaler, [0.0] * len(cols), 0.0)
        mean = np.array([scaler.mean[c] for c in cols]) - self.shift[at]
        scale = np.array([scaler.scale[c] for c in cols])
        pick = [1 + i for i in at]
        xbar, ybar = a[0, pick] / n, a[0, -1] / n
        xx = (a[np.ix_(pick, pick)] - n * np.outer(xbar, xbar)) / np.outer(scale, scale)
        xy = (a[pick, -1] - n * xbar * ybar) / scale
        w = np.linalg.solve(xx + alpha * np.eye(len(cols)), xy)
        return LinearScore(scaler, w.tolist(), float(ybar + self.target_shift - ((xbar - mean) / scale) @ w))


def statistics(
    df: DataFrame, cols: Sequence[str], parts: Mapping[str, Column], keys: Sequence[Key], target: str | None = None, year: str | None = None,
) -> Fitted:
    """Two passes over df, whatever the number of windows: value counts for the medians, then Gram matrices.

    Columns are shifted by their overall mean before they are multiplied, so that large values with little spread keep their
    digits. Rows whose target is null count for scalers only. NaN counts as missing.
    """
    cols = list(dict.fromkeys(cols))
    parts, keys = dict(parts), list(dict.fromkeys(keys))
    mids, shift = medians(df, cols, parts, keys, year) if cols else ({k: np.zeros(0) for k in keys}, np.zeros(0))
    p = len(cols)
    upper = np.triu_indices(2 * p + 2)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            m = _matrix(batch, 0)
            for first in range(0, len(m), _ROWS):
                rows = m[first : first + _ROWS]
                missing = np.isnan(rows[:, 3:])
                has = ~np.isnan(rows[:, 2])
                z = np.hstack([np.ones((len(rows), 1)), np.where(missing, 0.0, rows[:, 3:] - shift), missing, np.where(has, rows[:, 2], 0.0)[:, None]])
                of = np.stack([np.where(np.isnan(rows[:, 0]), _NO_YEAR, rows[:, 0]), rows[:, 1], has], axis=1).astype(np.int64)
                for cell in np.unique(of, axis=0):
                    mine = z[(of == cell).all(axis=1)]
                    key = tuple(cell.tolist())
                    sums[key] = sums.get(key, 0) + (mine.T @ mine)[upper]
        if sums:
            kinds = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in kinds), pa.array([v.tolist() for v in sums.values()])], ["year", "members", "labelled", "v"])

    y = F.col(target).cast("double") if target else F.lit(None).cast("double")
    y_shift = float((df.agg(F.avg(y)).first()[0] or 0.0)) if target else 0.0
    narrow = _narrow(df, cols, parts, year, {"_y": y - y_shift})
    grams = {}
    for key, flat in _summed(narrow.mapInArrow(gram, "year long, members long, labelled long, v array<double>"), ["year", "members", "labelled"]).items():
        g = np.zeros((2 * p + 2, 2 * p + 2))
        g[upper] = flat
        grams[tuple(int(k) for k in key)] = g + np.triu(g, 1).T
    return Fitted(cols, list(parts), mids, shift, y_shift, grams)


@dataclass
class Logistic:
    """One logistic fit: the rows of a window with a label, on scaled columns. `label` names a 0/1 column."""

    key: Key
    label: str
    scaler: Scaler
    balanced: bool = True


@dataclass
class _Newton:
    """State of one fit: the accepted point with its objective, and the candidate that the next pass judges."""

    beta: np.ndarray
    step: np.ndarray
    value: float = float("inf")
    done: bool = False

    @property
    def candidate(self) -> np.ndarray:
        return self.beta + self.step


def logistic_fits(
    df: DataFrame, fits: Mapping[object, Logistic], parts: Mapping[str, Column], year: str | None = None, c: float = 1.0, max_iter: int = 100, tol: float = 1e-10,
) -> dict[object, LinearScore]:
    """L2 logistic regressions by Newton's method, all fits in one pass per step; a fit whose rows have one class only is left out.

    Balanced weights are n / (2 n_k). The penalty is |coefficients|^2 / (2 c) beside weighted losses that add up, the intercept is
    free. A step that does not lower the objective is halved; a fit is done when its step is below `tol`. df should be materialised.
    """
    parts = dict(parts)
    cols = list(dict.fromkeys(x for f in fits.values() for x in f.scaler.cols))
    labels = list(dict.fromkeys(f.label for f in fits.values()))
    narrow = _narrow(df, cols, parts, year, {f"_y{i}": F.col(x) for i, x in enumerate(labels)})
    counted = narrow.groupBy("_year", "_members", *[f"_y{i}" for i in range(len(labels))]).count().collect()

    def class_counts(f: Logistic) -> tuple[int, int]:
        bit, name = 1 << list(parts).index(f.key[0]), f"_y{labels.index(f.label)}"
        rows = [r for r in counted if r["_members"] & bit and (f.key[1] is None or (r["_year"] is not None and r["_year"] <= f.key[1]))]
        return sum(r["count"] for r in rows if r[name] == 0), sum(r["count"] for r in rows if r[name] == 1)

    plans = []
    for name, f in fits.items():
        n0, n1 = class_counts(f)
        if n0 and n1:
            at = np.array([cols.index(x) for x in f.scaler.cols], int)
            mid, mean, scale = (np.array([d[x] for x in f.scaler.cols]) for d in (f.scaler.median, f.scaler.mean, f.scaler.scale))
            weights = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if f.balanced else (1.0, 1.0)
            bit = 1 << list(parts).index(f.key[0])
            plans.append((name, bit, f.key[1], labels.index(f.label), at, mid, mean, scale, weights))
    state = {i: _Newton(np.zeros(len(p[4]) + 1), np.zeros(len(p[4]) + 1)) for i, p in enumerate(plans)}

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Loss, gradient and upper Hessian of each fit at its point."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                m = _matrix(batch, 0)
                for first in range(0, len(m), _ROWS):
                    rows = m[first : first + _ROWS]
                    members = rows[:, 1].astype(np.int64)
                    for i, beta in points.items():
                        _, bit, end, label, at, mid, mean, scale, weights = plans[i]
                        y = rows[:, 2 + label]
                        mine = (members & bit != 0) & ~np.isnan(y)
                        if end is not None:
                            mine &= rows[:, 0] <= end  # a missing year compares as false
                        x = rows[mine][:, 2 + len(labels) + at]
                        z = np.hstack([np.ones((len(x), 1)), (np.where(np.isnan(x), mid, x) - mean) / scale])
                        y = y[mine]
                        w = np.where(y == 1, weights[1], weights[0])
                        s = z @ beta
                        p = 0.5 * (1 + np.tanh(s / 2))
                        loss = (w * (np.logaddexp(0, s) - y * s)).sum()
                        h = (z * (w * p * (1 - p))[:, None]).T @ z
                        part = np.concatenate([[loss], z.T @ (w * (p - y)), h[np.triu_indices(len(beta))]])
                        sums[i] = sums.get(i, 0) + part
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()])], ["fit", "v"])

        return {int(k[0]): v for k, v in _summed(narrow.mapInArrow(read, "fit long, v array<double>"), ["fit"]).items()}

    for _ in range(max_iter):
        points = {i: s.candidate for i, s in state.items() if not s.done}
        if not points:
            break
        for i, flat in evaluate(points).items():
            s, beta = state[i], points[i]
            k = len(beta)
            free = np.concatenate([[0.0], np.full(k - 1, 1.0 / c)])
            value = flat[0] + 0.5 * free @ beta**2
            if value > s.value + 1e-9 * (1 + abs(s.value)):
                s.step = s.step / 2
                s.done = bool(np.abs(s.step).max() < tol)
                continue
            h = np.zeros((k, k))
            h[np.triu_indices(k)] = flat[1 + k :]
            h = h + np.triu(h, 1).T + np.diag(free)
            s.beta, s.value = beta, value
            s.step = -np.linalg.solve(h + 1e-12 * np.eye(k), flat[1 : 1 + k] + free * beta)
            s.done = bool(np.abs(s.step).max() < tol)
    return {plans[i][0]: LinearScore(fits[plans[i][0]].scaler, s.beta[1:].tolist(), float(s.beta[0])) for i, s in state.items()}


def scored_by_year(df: DataFrame, year: str, scores: Mapping[int, Mapping[str, LinearScore | float]]) -> DataFrame:
    """Linear scores of every row with the models of its year, in one pass; rows of other years are left out.

    `scores` maps a year to named scores (or constants); each becomes a column. The models are a small table, one row per year,
    that is broadcast: its size is years x columns.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys(n for by_name in scores.values() for n in by_name))
    used = {n: list(dict.fromkeys(c for s in scores.values() if isinstance(s.get(n), LinearScore) for c in s[n].scaler.cols)) for n in names}
    rows = []
    for y, by_name in scores.items():
        row: list = [int(y)]
        for n in names:
            s = by_name[n]
            if isinstance(s, LinearScore):
                slope = {c: w / s.scaler.scale[c] for c, w in zip(s.scaler.cols, s.coef, strict=True)}
                base = s.intercept - sum(slope[c] * s.scaler.mean[c] for c in slope)
                row += [float(base), [float(slope.get(c, 0.0)) for c in used[n]], [float(s.scaler.median.get(c, 0.0)) for c in used[n]]]
            else:
                row += [None if s is None else float(s), [0.0] * len(used[n]), [0.0] * len(used[n])]
        rows.append(tuple(row))
    schema = "_model_year int, " + ", ".join(f"_b{i} double, _s{i} array<double>, _m{i} array<double>" for i in range(len(names)))
    models = spark.createDataFrame(rows, schema)
    joined = df.join(F.broadcast(models), F.col(year).cast("int") == F.col("_model_year"))
    out = {}
    for i, n in enumerate(names):
        terms = F.col(f"_b{i}")
        for j, c in enumerate(used[n]):
            terms = terms + F.coalesce(F.col(c).cast("double"), F.col(f"_m{i}")[j]) * F.col(f"_s{i}")[j]
        out[n] = terms
    return joined.withColumns(out).drop("_model_year", *[f"_{x}{i}" for i in range(len(names)) for x in "bsm"])
