"""Signals, costs, resampling and models: tiny frames, closed forms and leakage checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import scalars as sc
from eventide.operators import fuzzy, models, resample, trades


def test_top_fraction_ranks_inside_each_year(spark):
    rows = [(i + 10 * y, 2019 + y, float(i + 1 + 100 * y)) for y in (0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "catalyst_id int, test_year int, score double")
    got = sorted(r["score"] for r in trades.top_fraction(df, "score", 0.20).collect())
    assert got == [5.0, 105.0]
    with pytest.raises(ValueError):
        trades.top_fraction(df, "score", 0.0)
    with pytest.raises(KeyError):
        trades.top_fraction(df, "nope", 0.1)


def test_top_fraction_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, 1, 1.0), (1, 1, 1.0), (2, 1, None)], "catalyst_id int, test_year int, score double")
    assert [r["catalyst_id"] for r in trades.top_fraction(df, "score", 0.5).collect()] == [1]


def test_percentile_signals(spark):
    df = spark.createDataFrame([(i, 2020, i / 10) for i in range(10)], "catalyst_id int, test_year int, x double")
    got = {r["catalyst_id"]: r["trade_signal"] for r in trades.percentile_signals(df, "x", ["test_year"]).collect()}
    assert got[9] == "STRONG LONG" and got[0] == "STRONG SHORT" and got[7] == "LONG" and got[1] == "SHORT" and got[4] == "NO TRADE"


def test_only_explicit_signals_trade_and_cost_is_round_trip(spark):
    df = spark.createDataFrame([(1, "LONG", 0.2, 0.1), (2, "NO TRADE", 0.2, 0.1), (3, "STRONG SHORT", -0.2, 0.1)],
                               "catalyst_id int, trade_signal string, expected_car_adj double, realized_car double")
    got = {r["catalyst_id"]: (r["side"], r["slippage_cost"], round(r["net_return"], 6)) for r in trades.trade_ledger(df).collect()}
    assert got == {1: (1, 0.005, 0.095), 3: (-1, 0.005, -0.105)}
    assert trades.trade_ledger(df, fallback=True).count() == 3


def test_top_k_row_in_both_ends_is_short(spark):
    df = spark.createDataFrame([(1, 2020, 0.1)], "catalyst_id int, test_year int, x double")
    assert {r["side"] for r in trades.top_k_sides(df, "x").collect()} == {-1}


def test_bootstrap_agrees_with_theory(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0.02, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "v": v}))
    se = v.std() / 20
    m = resample.bootstrap_means(df, "v", "id", n_boot=300).toPandas()["mean"]
    assert len(m) == 300 and abs(m.mean() - v.mean()) < 4 * se / np.sqrt(300) and 0.85 < m.std() / se < 1.15


def test_residual_intervals_are_the_residuals_percentiles(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, 301)
    res = spark.createDataFrame(pd.DataFrame({"i": np.arange(301), "e": e}))
    preds = spark.createDataFrame([(1, 0.5), (2, None)], "id long, p double")
    got = {r.id: (r.lo, r.hi) for r in resample.residual_intervals(preds, res, "id", "p", "e").collect()}
    assert np.allclose(got[1], 0.5 + np.percentile(e, [2.5, 97.5])) and got[2] == (None, None)
    assert resample.residual_intervals(preds, res.limit(0), "id", "p", "e").first()["lo"] == 0.5


def test_block_bootstrap_of_one_year_is_constant(spark):
    df = spark.createDataFrame([(1, 2020, 0.1), (2, 2020, 0.3)], "id int, y int, v double")
    m = {round(r["mean"], 9) for r in resample.block_bootstrap(df, "v", "y", n_boot=5).collect()}
    assert m == {0.2}


def _train(n=120, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + rng.normal(size=n) > 0.3).astype(int)
    d = pd.DataFrame(x, columns=list("abc"))
    d.loc[d.index % 9 == 0, "b"] = np.nan
    d["const"], d["empty"] = 2.0, np.nan
    d["clinical_success"], d["realized_car"] = y, 0.1 * y + 0.05 * x[:, 0] + rng.normal(0, 0.02, n)
    d["catalyst_id"] = np.arange(n)
    return d


COLS = ["a", "b", "c", "const", "empty"]


def _z(d):
    z = d[COLS].fillna(d[COLS].median()).fillna(0.0)
    sd = z.std(ddof=0)
    return ((z - z.mean()) / sd.where(sd > 1e-12, 1.0)).to_numpy()


def _spark_frame(spark, d):
    return spark.createDataFrame(d.astype(object).where(d.notna(), None),
                                 "a double, b double, c double, const double, empty double, clinical_success int, realized_car double, catalyst_id long")


@pytest.mark.parametrize("alpha", [1.0, 5.0])
def test_ridge_closed_form(spark, alpha):
    d = _train()
    m = models.fit_ridge(_spark_frame(spark, d), COLS, "realized_car", alpha)
    z, y = _z(d), d.realized_car.to_numpy()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(5), z.T @ (y - y.mean()))
    assert np.allclose(m.coef, w, atol=1e-9) and m.intercept == pytest.approx(y.mean())


def test_logistic_gradient_vanishes(spark):
    d = _train()
    m = models.fit_logistic(_spark_frame(spark, d), COLS, "clinical_success")
    z, y = _z(d), d.clinical_success.to_numpy()
    wt = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(z @ np.array(m.coef) + m.intercept)))
    grad = z.T @ (wt * (p - y)) + np.array(m.coef)
    assert np.abs(grad).max() < 1e-2 and abs((wt * (p - y)).sum()) < 1e-2


def test_test_outcomes_cannot_change_predictions(spark):
    d = _train()
    d["catalyst_year"] = np.where(d.index < 80, 2018, 2019)
    flipped = d.copy()
    late = flipped.catalyst_year == 2019
    flipped.loc[late, "clinical_success"] = 1 - flipped.loc[late, "clinical_success"]
    flipped.loc[late, "realized_car"] = -5.0

    def run(frame):
        s = _spark_frame(spark, frame.drop(columns="catalyst_year")).withColumn(
            "catalyst_year", F.when(F.col("catalyst_id") < 80, 2018).otherwise(2019)).withColumns(
            {"ticker": F.lit("A"), "company_dependency": F.lit(None).cast("double")})
        out = models.walk_forward(s, COLS, ["a", "c"], 2018).orderBy("catalyst_id")
        return out.select("p_success", "expected_car", "expected_car_adj").toPandas()

    a, b = run(d), run(flipped)
    assert len(a) == 40 and np.allclose(a, b)
    assert np.allclose(a.expected_car_adj, a.expected_car * 0.9)


def test_tail_fold_without_drops_keeps_the_base_rate(spark):
    d = _train()
    s = _spark_frame(spark, d).filter("realized_car > -0.2")
    m = models.fit_tail_risk(s, ["a", "c"])
    out = models.predict_tail_risk(s.withColumn("realized_car", F.lit(-9.0)), m).select("p_major_drop", "expected_drop_magnitude").distinct().collect()
    assert [tuple(r) for r in out] == [(0.0, -0.2)]


def test_ranking_refuses_unproven_models():
    with pytest.raises(FileNotFoundError):
        models.require_provenance(None)
    with pytest.raises(ValueError):
        models.require_provenance(models.ExpectedCar(None, None, None, 0.0, 0.0))


def test_enhanced_dependency_is_capped(spark):
    c = F.lit
    e = sc.enhanced_dependency(c(0.9), c(1), c(1), c(3.0), c(0))
    f = sc.enhanced_dependency(c(0.2), c(0), c(0), c(1.0), c(1))
    row = spark.range(1).select(e, f).first()
    assert row[0] == 1.0 and row[1] == pytest.approx(0.1)


def test_fuzzy_match_by_brute_force(spark):
    import datetime as dt

    rng = np.random.default_rng(5)
    words = ["alpha mab", "alphamab", "beta nib", "betanib x", "gamma", "delta-one"]
    day = lambda: dt.date(2015, 1, 1) + dt.timedelta(days=int(rng.integers(0, 2500)))
    reg = [(i, "hot" if i % 3 else "cold", str(rng.choice(words)), day(), None) for i in range(60)]
    ext = [(i, "HOT" if i % 3 else "COLD", str(rng.choice(words)).upper(), day()) for i in range(80)]
    r = spark.createDataFrame(reg, "catalyst_id int, ticker string, drug_name string, announcement_date date, announcement_source string")
    e = spark.createDataFrame(ext, "event_id int, ticker string, drug string, event_date date")
    got = {x["catalyst_id"]: (x["matched_date"], x["drug_score"]) for x in fuzzy.match_events(r, e).collect()}
    norm = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())

    def score(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, e in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return 0.95 if a in b or b in a else 1 - row[-1] / max(len(a), len(b))

    for cid, tk, name, d, _ in reg:
        cand = [(-score(norm(name), norm(n)), abs((ed - d).days), ed, eid) for eid, t, n, ed in ext
                if t == tk.upper() and abs((ed - d).days) <= 365 and score(norm(name), norm(n)) >= 0.45]
        want = (min(cand)[2], round(-min(cand)[0], 3)) if cand else (None, None)
        assert got[cid] == want


def test_name_candidates_lose_no_pair_and_are_few(spark):
    rng = np.random.default_rng(9)
    alphabet = list("abcdefghijklmnopqrstuvwxyz0123456789 é")
    names = ["".join(rng.choice(alphabet, int(rng.integers(1, 14)))) for _ in range(150)]
    names += [n[:-1] + "x" for n in names[:60]] + ["", "aa", "aaa", "alpha mab", "alphamab"]
    left = spark.createDataFrame([("T", n) for n in names[:120]], "ticker string, name string")
    right = spark.createDataFrame([("T", n) for n in names], "ticker string, name string")
    scored = left.join(right.withColumnRenamed("name", "other"), "ticker").withColumn("score", fuzzy.similarity(F.col("name"), F.col("other"), fuzzy.levenshtein_ratio))
    for floor in (0.45, 0.6):
        want = {(r.name, r.other) for r in scored.filter(F.col("score") >= floor).collect()}
        for task in (2_000_000, 50):
            fuzzy.PAIRS_A_TASK, kept = task, fuzzy.PAIRS_A_TASK
            got = {(r.name, r.other) for r in fuzzy.candidate_names(left, right, dated=False, floor=floor).collect()}
            fuzzy.PAIRS_A_TASK = kept
            assert want <= got and len(got) < (0.5 if floor < 0.5 else 0.25) * scored.count()


def test_fuzzy_match_pairs_dates_with_the_nearest_event_only(spark):
    """A ticker with one name and an event every day: pairs of dates with all events within a year would be 1,600 x 730 rows."""
    import datetime as dt

    day = lambda i: dt.date(2010, 1, 1) + dt.timedelta(days=i)
    reg = spark.createDataFrame(
        [(i, "T", "alpha mab", day(i), None) for i in range(400, 2000)] + [(5000, "T", "alpha mab", None, None), (5001, "T", "alpha mab", day(3000), None)],
        "catalyst_id int, ticker string, drug_name string, announcement_date date, announcement_source string")
    ext = spark.createDataFrame([(7 * i, "t", "Alpha-Mab", day(i)) for i in range(2400) if i % 4] + [(3, "T", "alpha mab", day(401))],
                                "event_id int, ticker string, drug string, event_date date")
    got = {r.catalyst_id: r for r in fuzzy.match_events(reg, ext).collect()}
    assert len(got) == 1602 and got[5000].match_status == got[5001].match_status == "NO_MATCH"
    for i in range(400, 2000):  # each fourth day has no event: the day before wins the tie
        assert got[i].matched_date == (day(i) if i % 4 else day(i - 1)) and got[i].match_status == "EXACT"
    assert got[401].matched_drug == "alpha mab" and got[402].matched_drug == "Alpha-Mab"
    pairs = spark.createDataFrame([("T", "alpha mab", day(i)) for i in range(400, 2000)], "ticker string, other string, announcement_date date")
    days = ext.selectExpr("upper(ticker) as ticker", "'alpha mab' as other", "event_date", "event_id", "drug").filter("event_id > 3")
    near = fuzzy.nearest_days(pairs, days).collect()
    assert len(near) == 1600 and all(r.gap == (r.announcement_date - r.event_date).days for r in near)


def test_fuzzy_match_meets_lower_names_only_where_the_best_are_out_of_reach(spark, monkeypatch):
    """One name with its equal and 20 near ones, all with an event a day: 300 dates meet one name each, but for those a year off its events."""
    import datetime as dt

    day = lambda i: dt.date(2010, 1, 1) + dt.timedelta(days=i)
    reg = spark.createDataFrame([(i, "T", "alpha mab", day(3 * i), None) for i in range(300)],
                                "catalyst_id int, ticker string, drug_name string, announcement_date date, announcement_source string")
    near = [f"alphx ma{c}" for c in "acdefghijklmnopqrstu"]
    ext = [(i, "T", "Alpha-Mab", day(i)) for i in range(0, 500)] + [(1000 * k + i, "T", n, day(i)) for k, n in enumerate(near, 1) for i in range(0, 890)]
    events = spark.createDataFrame(ext, "event_id int, ticker string, drug string, event_date date")
    met, nearest = [], fuzzy.nearest_days
    monkeypatch.setattr(fuzzy, "nearest_days", lambda pairs, days: met.append(pairs.count()) or nearest(pairs, days))
    got = {r.catalyst_id: r for r in fuzzy.match_events(reg, events).collect()}
    far = [i for i in range(300) if 3 * i > 499 + 365]
    for i in range(300):
        want = (day(3 * i) if 3 * i < 890 else day(889), 0.778) if i in far else (day(min(3 * i, 499)), 0.95)
        assert (got[i].matched_date, got[i].drug_score) == want
    assert got[far[0]].matched_drug == "alphx maa" and sum(met) == 300 + 20 * len(far)
