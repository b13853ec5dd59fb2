"""SQL of the model fits: medians and scales by aggregates, ridge by normal equations, logistic by recursive Newton steps.

A fit is given by `rows`: a query with a window id `win`, the target `y` and the feature columns. CTEs of a fit named n:
n_s (win, median, mean and scale of each column), n_z (win, y, w, scaled columns), n (win, b: intercept, then coefficients).
"""

from __future__ import annotations

from collections.abc import Sequence


def _solved(matrix: str, k: int) -> str:
    """Gauss-Jordan elimination of k rows with one right-hand column (positive definite, so without pivots)."""
    return (
        f"list_reduce(range(1, {k + 1}), lambda m, k: list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) "
        f"ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END), {matrix})"
    )


def scaled(name: str, rows: str, cols: Sequence[str], balanced: bool = True, plain: Sequence[str] = ()) -> str:
    """CTEs <name>_r, _s and _z: rows, parameters of the scaler, scaled rows with class weights. `plain` columns stay as they are."""
    weight = "count(*) OVER (PARTITION BY win) / (2e0 * count(*) OVER (PARTITION BY win, y))" if balanced else "1e0"
    med = ", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0e0) AS m_{c}" for c in cols)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in cols)
    stats = ", ".join(
        f"0e0 AS a_{c}, 1e0 AS s_{c}" if c in plain else f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1e0 END AS s_{c}" for c in cols)
    z = ", ".join(f"({c} - a_{c}) / s_{c} AS x{i + 1}" for i, c in enumerate(cols))
    return f"""{name}_r AS MATERIALIZED (SELECT win, CAST(y AS DOUBLE) AS y, {', '.join(cols)} FROM ({rows})),
{name}_m AS MATERIALIZED (SELECT win, {med} FROM {name}_r GROUP BY win),
{name}_f AS MATERIALIZED (SELECT r.win, r.y, {filled} FROM {name}_r r JOIN {name}_m USING (win)),
{name}_s AS MATERIALIZED (SELECT * FROM (SELECT win, count(*) AS n_rows, avg(y) AS y_mean, {stats} FROM {name}_f GROUP BY win) JOIN {name}_m USING (win)),
{name}_z AS MATERIALIZED (SELECT f.win, y, {weight} AS w, {z} FROM {name}_f f JOIN {name}_s USING (win))"""


def _sums(xs: Sequence[str], weight: str, residual: str) -> tuple[str, int]:
    k = len(xs)
    h = [f"sum({weight} * {xs[i]} * {xs[j]}) AS h{i}_{j}" for i in range(k) for j in range(i, k)]
    return ", ".join([*h, *(f"sum({residual} * {x}) AS g{i}" for i, x in enumerate(xs))]), k


def ridge(name: str, rows: str, cols: Sequence[str], alpha: float) -> str:
    """Scaled ridge with a free intercept: the scaled columns have mean 0, so the intercept is the mean target."""
    xs = [f"x{i + 1}" for i in range(len(cols))]
    sums, k = _sums(xs, "1e0", "(y - y_mean)")
    m = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)}" + (f" + {alpha}::DOUBLE" if i == j else "") for j in range(k)] + [f"g{i}"]) + "]" for i in range(k))
    return f"""{scaled(name, rows, cols, False)},
{name} AS MATERIALIZED (SELECT win, list_prepend(y_mean, list_transform(s, lambda r: r[{k + 1}])) AS b FROM (SELECT win, y_mean, {_solved(f'[{m}]', k)} AS s
  FROM (SELECT z.win, y_mean, {sums} FROM {name}_z z JOIN (SELECT win, y_mean FROM {name}_s) USING (win) GROUP BY z.win, y_mean)))"""


def logistic(name: str, rows: str, cols: Sequence[str], balanced: bool = True, plain: Sequence[str] = (), steps: int = 14) -> str:
    """L2 logistic (C = 1, free intercept) by `steps` Newton steps from 0. Needs WITH RECURSIVE."""
    xs = ["1e0", *(f"x{i + 1}" for i in range(len(cols)))]
    sums, k = _sums(xs, "w * p * (1 - p)", "w * (p - y)")
    line = " + ".join(f"b[{i + 1}] * {x}" for i, x in enumerate(xs))
    m = ", ".join(
        "[" + ", ".join([f"h{min(i, j)}_{max(i, j)}" + (" + 1e0" if i == j and i else "") for j in range(k)] + [f"g{i}" + (f" + b[{i + 1}]" if i else "")]) + "]"
        for i in range(k)
    )
    return f"""{scaled(name, rows, cols, balanced, plain)},
{name}_it AS (SELECT 0 AS it, win, {[0.0] * k}::DOUBLE[] AS b FROM (SELECT win FROM {name}_z GROUP BY win HAVING count(DISTINCT y) = 2)
UNION ALL SELECT it + 1, win, list_transform(b, lambda v, i: v - s[i][{k + 1}]) FROM (SELECT it, win, b, {_solved(f'[{m}]', k)} AS s FROM (
  SELECT it, win, b, {sums} FROM (SELECT i.it, i.win, i.b, z.* EXCLUDE (win), 1 / (1 + exp(-({line}))) AS p
    FROM {name}_it i JOIN {name}_z z USING (win) WHERE i.it < {steps}) GROUP BY it, win, b))),
{name} AS MATERIALIZED (SELECT win, b FROM {name}_it WHERE it = {steps})"""


def line(name: str, cols: Sequence[str], row: str) -> str:
    """The linear score of a row `row` by the fit whose tables are joined as <name> and <name>_s."""
    terms = [f"{name}.b[{i + 2}] * (coalesce(CAST({row}.{c} AS DOUBLE), {name}_s.m_{c}) - {name}_s.a_{c}) / {name}_s.s_{c}" for i, c in enumerate(cols)]
    return " + ".join([f"{name}.b[1]", *terms])


def joined(name: str, row: str, win: str = "win") -> str:
    return f"LEFT JOIN {name} ON {name}.win = {row}.{win} LEFT JOIN {name}_s ON {name}_s.win = {row}.{win}"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def expected_car(name: str, source: str, wins: str, p_cols: Sequence[str], car_cols: Sequence[str], tests: str) -> str:
    """CTE <name>: rows of `tests` (with win) and p_success, e_success, e_failure, expected_car of the models of their window.

    `wins` (win) and `source` (training rows with win) are queries or tables; means replace return models of fewer than 5 rows.
    """
    def rows(y: str, where: str, cols: Sequence[str]) -> str:
        return f"SELECT win, {y} AS y, {', '.join(cols)} FROM {source} WHERE {where}"

    parts = [
        logistic(f"{name}_p", rows("clinical_success", "clinical_success IS NOT NULL", p_cols), p_cols),
        ridge(f"{name}_one", rows("realized_car", "clinical_success = 1", car_cols), car_cols, 1.0),
        ridge(f"{name}_nil", rows("realized_car", "clinical_success = 0", car_cols), car_cols, 1.0),
    ]

    def mean_car(fit: str, default: float) -> str:
        return f"CASE WHEN {fit}_s.n_rows >= 5 THEN {line(fit, car_cols, 't')} ELSE coalesce({fit}_s.y_mean, {default}::DOUBLE) END"

    return ",\n".join(parts) + f""",
{name}_e AS MATERIALIZED (SELECT t.*, {sigmoid(line(f'{name}_p', p_cols, 't'))} AS p_success, {mean_car(f'{name}_one', 0.0)} AS e_success,
    {mean_car(f'{name}_nil', -0.10)} AS e_failure
  FROM {tests} t {joined(f'{name}_p', 't')} {joined(f'{name}_one', 't')} {joined(f'{name}_nil', 't')}),
{name} AS (SELECT *, p_success * e_success + (1 - p_success) * e_failure AS expected_car FROM {name}_e)"""
