"""Windows fitted together: brute-force medians, closed forms, convergence, one pass of predictions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import ablation, models, ranking, resample, studies, windows
from eventide.session import spread

COLS = ["a", "b", "big", "const", "empty"]
SCHEMA = "id long, year int, y int, car double, a double, b double, big double, const double, empty double"


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"id": np.arange(n), "year": rng.integers(2010, 2016, n).astype(object), "a": rng.normal(size=n), "b": np.round(rng.normal(size=n), 1) * 5})
    d["big"], d["const"], d["empty"] = 1e9 + rng.normal(size=n), 2.0, np.nan
    d["y"] = (d.a + rng.normal(size=n) > 0.2).astype(int)
    d["car"] = 0.1 * d.y + 0.03 * d.a + rng.normal(0, 0.02, n)
    d.loc[d.index % 7 == 0, "b"] = np.nan
    d.loc[d.index % 11 == 0, "car"] = np.nan
    d.loc[d.index % 50 == 0, "year"] = None
    return d


def frame(spark, d):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame(d[cols].astype(object).where(d[cols].notna(), None), SCHEMA).repartition(5)


def window(d, part, end):
    inside = d if end is None else d[d.year.notna() & (d.year.fillna(9999).astype(int) <= end)]
    return inside[inside.y == 1] if part == "hit" else inside


def scaled(w, d):
    z = w[COLS].astype(float)
    mid = z.median().fillna(0.0)
    z = z.fillna(mid)
    sd = z.std(ddof=0)
    return ((d[COLS].astype(float).fillna(mid) - z.mean()) / sd.where(sd > 1e-9, 1.0)).to_numpy()


KEYS = [(p, e) for p in ("all", "hit") for e in (2011, 2013, None)]


def parts():
    return {"all": F.lit(True), "hit": F.col("y") == 1}


def test_scalers_and_ridge_of_all_windows_equal_brute_force(spark):
    d = data()
    found = windows.statistics(frame(spark, d), COLS, parts(), KEYS, "car", "year")
    for part, end in KEYS:
        w = window(d, part, end)
        s = found.scaler((part, end))
        want = w[COLS].astype(float).median().fillna(0.0)
        assert np.allclose([s.median[c] for c in COLS], want)
        labelled = w[w.car.notna()]
        z, y = scaled(w, labelled), labelled.car.to_numpy()
        assert found.count((part, end)) == len(labelled) and found.count((part, end), False) == len(w)
        assert found.target_mean((part, end)) == pytest.approx(y.mean(), abs=1e-12)
        for cols in (COLS, ["a", "b"]):
            at = [COLS.index(c) for c in cols]
            zc = z[:, at] - z[:, at].mean(axis=0)
            coef = np.linalg.solve(zc.T @ zc + 3 * np.eye(len(cols)), zc.T @ (y - y.mean()))
            m = found.ridge((part, end), 3.0, cols)
            assert np.allclose(m.coef, coef, atol=1e-6) and m.intercept == pytest.approx(y.mean() - z[:, at].mean(axis=0) @ coef, abs=1e-6)


def test_statistics_read_the_frame_twice(spark):
    """A batch counter in a Python scan of the source: the value counts and the Gram matrices, and the mean of the target."""
    d = data(50)
    seen = spark.sparkContext.accumulator(0)

    def scan(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = frame(spark, d)
    windows.statistics(df.mapInArrow(scan, df.schema), COLS, parts(), KEYS, None, "year")
    assert seen.value <= 2 * len(d)


def newton(z, y, w, steps=40):
    z = np.hstack([np.ones((len(z), 1)), z])
    b, free = np.zeros(z.shape[1]), np.r_[0.0, np.ones(z.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(free) + 1e-12 * np.eye(len(b)), z.T @ (w * (p - y)) + free * b)
    return b


def test_logistic_fits_converge_together(spark):
    d = data()
    d["rare"] = (d.id % 97 == 0).astype(int)
    df = frame(spark, d).withColumn("rare", (F.col("id") % 97 == 0).cast("int")).withColumn("same", F.lit(1))
    everything = {"all": F.lit(True)}
    keys = [("all", e) for e in (2011, 2014, None)]
    found = windows.statistics(df, COLS, everything, keys, None, "year")
    fits = {(label, k[1]): windows.Logistic(k, label, found.scaler(k, ["a", "b"]), balanced) for k in keys for label, balanced in (("y", True), ("rare", False))}
    fits["one class"] = windows.Logistic(keys[0], "same", found.scaler(keys[0], ["a"]))
    got = windows.logistic_fits(df, fits, everything, "year")
    assert "one class" not in got and len(got) == 6
    for (label, end), m in got.items():
        w = window(d, "all", end)
        y = w[label].to_numpy().astype(float)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if label == "y" else np.ones(len(y))
        want = newton(scaled(w, w)[:, :2], y, weight)
        assert np.allclose([m.intercept, *m.coef], want, atol=1e-8), (label, end)


def test_scores_by_year_equal_the_scores_of_each_year(spark):
    d = data()
    df = frame(spark, d)
    found = windows.statistics(df, COLS, {"all": F.lit(True)}, [("all", 2012), ("all", 2013)], "car", "year")
    ms = {2013: found.ridge(("all", 2012), 1.0), 2014: found.ridge(("all", 2013), 1.0, ["a"])}
    got = windows.scored_by_year(df, "year", {y: {"s": m, "k": float(y)} for y, m in ms.items()}).select("id", "year", "s", "k").collect()
    assert {r.year for r in got} == {2013, 2014} and all(r.k == r.year for r in got)
    want = {r.id: r.s for y, m in ms.items() for r in df.filter(F.col("year") == y).select("id", m.linear().alias("s")).collect()}
    assert len(got) == len(want) and all(abs(r.s - want[r.id]) < 1e-9 for r in got)


def test_feature_sets_share_passes_and_equal_single_fits(spark):
    d = data()
    df = frame(spark, d).filter("car is not null").withColumnsRenamed({"y": "clinical_success", "car": "realized_car"})
    sets = {"one": ["a"], "two": ["a", "b"], "none_seen": ["empty"]}
    together = ablation.expected_car_models(df, sets, ["b"])
    for name, cols in sets.items():
        alone = models.fit_expected_car(df, cols, ["b"])
        for x, y in ((together[name].p_success, alone.p_success), (together[name].success, alone.success), (together[name].failure, alone.failure)):
            assert np.allclose([x.intercept, *x.coef], [y.intercept, *y.coef], atol=1e-9)
    scored = ablation.scored_sets(df, together, ["id"]).groupBy("model").count().collect()
    assert {r.model: r["count"] for r in scored} == dict.fromkeys(sets, df.count())


def test_a_constant_expectation_has_no_correlation_over_partitions(spark):
    """Merged over partitions, equal values have a variance above 0; that of the base rate was taken for a spread."""
    rows = spark.range(0, 300, 1, 7).select(
        F.lit("base_rate").alias("model"), F.lit(0.0123).alias("expected_car"), F.sin("id").alias("realized_car"))
    varied = rows.withColumns({"model": F.lit("varied"), "expected_car": F.col("realized_car") * 2 + 1})
    got = {r.model: r.corr for r in ablation.summary(rows.union(varied), ["model"]).collect()}
    assert got["base_rate"] is None and abs(got["varied"] - 1) < 1e-9


def test_ranking_is_prospective_and_prefers_exported_residuals(spark):
    d = data(120)
    df = frame(spark, d).filter("car is not null").withColumnsRenamed({"y": "clinical_success", "car": "realized_car", "id": "catalyst_id"}).withColumns(
        {"ticker": F.lit("T"), "company_dependency": F.lit(None).cast("double"), "announcement_date": F.make_date(F.col("year"), F.lit(6), F.lit(1))})
    m = models.fit_expected_car(df, ["a"], ["b"])
    ten = spark.createDataFrame([(i, 0.5) for i in range(10)], "id long, residual double")
    few = ten.limit(9)
    more = spark.createDataFrame([(i, 2.0) for i in range(40)], "id long, residual double")
    with pytest.raises(ValueError, match="date"):
        ranking.rank(df, m, [("export", ten)], None)
    got = ranking.rank(df, m, [("export", ranking.export_residuals(df.withColumn("expected_car", F.col("realized_car") - 0.5))), ("ledger", more)], "2014-01-01").collect()
    assert {r.interval_source for r in got} == {"export"} and all(r.announcement_date is None or r.announcement_date >= dt.date(2014, 1, 1) for r in got)
    assert got and all(abs((r.hi - r.lo) - 0.9) < 1e-9 for r in got) and sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    got = ranking.rank(df, m, [("export", few), ("ledger", more), ("in_sample", few)], None, include_historical=True).collect()
    assert len(got) == df.count() and {r.interval_source for r in got} == {"ledger"}
    for bad in (None, models.ExpectedCar(None, None, None, 0.0, 0.0)):
        with pytest.raises((FileNotFoundError, ValueError)):
            ranking.rank(df, bad, [("export", ten)], "2014-01-01")


def test_preclinical_evidence_is_what_was_public(spark):
    day = dt.date
    ev = spark.createDataFrame([(1, 7, day(2010, 1, 1)), (2, 7, day(2012, 1, 1)), (3, 8, day(2012, 1, 1)), (4, None, day(2012, 1, 1)), (5, 7, None)], "catalyst_id long, program_id long, cutoff date")
    st = [(7, day(2009, 5, 1), 0.3, "verified"), (7, day(2010, 1, 1), 0.1, "verified"), (7, day(2011, 1, 1), 0.2, "verified"), (7, day(2011, 1, 1), 9.0, "pending"),
          (7, day(2013, 1, 1), 5.0, "verified"), (7, None, 7.0, "verified"), (7, day(2011, 2, 1), None, "verified"), (7, day(2011, 3, 1), 0.2, "verified")]
    s = spark.createDataFrame(st, "program_id long, publication_date date, effect_size double, verification_status string")
    got = {r.catalyst_id: tuple(r)[1:] for r in studies.preclinical_as_of(ev, s).collect()}
    assert got == {1: (1, 2, 2, 0.3), 2: (1, 6, 5, 0.2), 3: (0, 0, 0, None), 4: (0, 0, 0, None), 5: (0, 0, 0, None)}


def test_preclinical_evidence_is_dealt_out_by_its_probes(spark):
    """The groups of a task do not grow with the table: ten times the probes are ten times the tasks, with the same results."""
    base = spark.range(40).selectExpr("id as catalyst_id", "id % 20 as program_id", "date_add(date'2010-01-01', int(id * 37)) as cutoff")
    s = spark.range(400).selectExpr("id % 20 as program_id", "date_add(date'2009-06-01', int(id * 5)) as publication_date", "(id % 7) / 10 as effect_size", "'verified' as verification_status")
    n, kept = int(spark.conf.get("spark.sql.shuffle.partitions")), studies.PROBES_A_TASK
    want = sorted(map(tuple, studies.preclinical_as_of(base, s).collect()))
    try:
        studies.PROBES_A_TASK = 1
        assert sorted(map(tuple, studies.preclinical_as_of(base, s).collect())) == want and len(want) == 40 and any(r[3] for r in want)
    finally:
        studies.PROBES_A_TASK = kept
    assert spread(base, "program_id").rdd.getNumPartitions() == spread(base, "program_id", rows=40, a_task=40).rdd.getNumPartitions() == n
    assert spread(base, "program_id", rows=400, a_task=10).rdd.getNumPartitions() == 40


def test_replicate_sums_are_exact_and_order_free(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), str(g), float(v)) for i, g, v in zip(rng.integers(0, 10_000, 700), rng.choice(["x", "y"], 700), np.round(rng.normal(50_000, 9_000, 700), 2), strict=True)]
    df = spark.createDataFrame([*rows, (None, "x", 1.0), (5, "x", None), (6, None, 2.0)], "id long, g string, v double")
    got = [sorted(map(tuple, resample.replicate_sums(df.repartition(n), ["v"], "id", ["g"], 20, 7).collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 60
    ids = np.array([r[0] for r in rows])
    weights = resample.poisson_of(resample.draws(ids, np.arange(20), 7)).astype(int)
    same = resample.with_draw(spark.createDataFrame([(i, b) for i in ids[:40].tolist() for b in range(3)], "i long, b long"), 7, "b", "i", "d").collect()
    assert all(resample.draws(np.array([r.i]), np.array([r.b]), 7)[0, 0] == r.d for r in same)
    for g, b, n, hi, lo in got[0]:
        if g is not None:
            mine = [(int(w), int(np.floor(v * 2.0**40))) for (_, h, v), w in zip(rows, weights[:, b], strict=True) if h == g]
            assert n == sum(w for w, _ in mine) and (hi << 30) + lo == sum(w * q for w, q in mine)


def test_draws_take_a_fraction_of_plain_remainders():
    """The same integers as the definition, up to the largest ids and below zero, without a division a cell."""
    import time

    def plain(ids, replicates, seed):
        p, i, b = resample.PRIME, ids.astype(np.int64)[:, None], replicates.astype(np.int64)
        u0 = np.fmod(i * 48271 + b * 69621 + (seed * 16807 + 12345), p)
        u1 = np.fmod(u0 * u0 + i + 7, p)
        u2 = np.fmod(u1 * u1 + b * 7919 + 1, p)
        return np.fmod(u2 * u2 + u0, p)

    rng = np.random.default_rng(4)
    for low, high in ((0, 100), (0, 2**31), (2**40 - 50, 2**40 + 50), (-100, 100)):
        ids = rng.integers(low, high, 300)
        assert (resample.draws(ids, np.arange(500), 42) == plain(ids, np.arange(500), 42)).all()
    took = {}
    for f in (plain, resample.draws):
        best = []
        for _ in range(7):
            t = time.perf_counter()
            f(np.arange(13), np.arange(5000), 42)
            best.append(time.perf_counter() - t)
        took[f] = min(best)
    assert took[resample.draws] < 0.7 * took[plain]
