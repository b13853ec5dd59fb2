"""Series, as-of joins and the event study on small frames, against NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import asof, eventstudy, features, series

D = dt.date


def test_forward_session_never_goes_back(spark):
    s = spark.createDataFrame([("A", D(2024, 1, 5)), ("A", D(2024, 1, 8))], "t string, d date")
    ev = spark.createDataFrame([(1, "A", D(2024, 1, 7)), (2, "A", D(2024, 1, 9)), (3, "A", D(2024, 1, 5)), (4, "B", D(2024, 1, 5))],
                               "id int, t string, e date")
    got = {r["id"]: r["s"] for r in asof.forward_session(ev, s, "t", "e", "d", "s").collect()}
    assert got == {1: D(2024, 1, 8), 2: None, 3: D(2024, 1, 5), 4: None}


def test_nearest_prefers_the_later_on_ties(spark):
    s = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2024, 1, 5))], "t string, d date")
    ev = spark.createDataFrame([(1, "A", D(2024, 1, 3)), (2, "A", D(2024, 1, 2)), (3, "A", D(2024, 2, 1))], "id int, t string, e date")
    got = {r["id"]: r["s"] for r in asof.nearest_session(ev, s, "t", "e", "d", "s").collect()}
    assert got == {1: D(2024, 1, 5), 2: D(2024, 1, 1), 3: D(2024, 1, 5)}


@pytest.mark.parametrize("strict,want", [(False, 20.0), (True, 10.0)])
def test_backward_strictness(spark, strict, want):
    facts = spark.createDataFrame([("A", D(2024, 1, 1), 10.0), ("A", D(2024, 1, 3), 20.0)], "k string, d date, v double")
    left = spark.createDataFrame([("A", D(2024, 1, 3))], "k string, c date")
    out = asof.backward_state(left, facts, ["k"], "c", "d", F.col("d"), ["v"], "f", strict=strict)
    assert out.first()["f"]["v"] == want


def _bars(n=420, seed=0, start=D(2020, 1, 1)):
    rng = np.random.default_rng(seed)
    days = [start + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"ticker": "A", "date": days, "adj_close": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), "volume": 1e6})


def _frames(spark, bars):
    rng = np.random.default_rng(9)
    px = {b: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(bars)))) for b in ("SPY", "XBI")}
    bench = pd.concat([pd.DataFrame({"benchmark": b, "date": bars.date, "adj_close": v}) for b, v in px.items()])
    sbars, wide = spark.createDataFrame(bars), series.benchmark_returns(spark.createDataFrame(bench))
    ref = pd.DataFrame({"r": bars.adj_close.pct_change(), "m": pd.Series(px["SPY"]).pct_change(), "x": pd.Series(px["XBI"]).pct_change()})
    ref.index = bars.date
    return sbars, wide, ref.dropna()


def test_event_study_matches_numpy(spark):
    bars = _bars()
    sbars, wide, ref = _frames(spark, bars)
    days = [D(2020, 12, 1), D(2020, 9, 1), D(2021, 2, 20), D(2021, 3, 5)]
    ev = spark.createDataFrame(list(enumerate(days)), "catalyst_id int, announcement_date date").withColumn("ticker", F.lit("A"))
    ev = ev.unionByName(spark.createDataFrame([(9, D(2020, 12, 1), "Z")], "catalyst_id int, announcement_date date, ticker string"))
    odd = spark.createDataFrame([(10, D(2020, 12, 1), None), (11, None, "A")], "catalyst_id int, announcement_date date, ticker string")
    ev = ev.unionByName(odd)
    out = eventstudy.event_study(ev, series.align(series.simple_returns(sbars), wide), sbars).toPandas()
    status = out.drop_duplicates("catalyst_id").set_index("catalyst_id").price_status.to_dict()
    assert status == {0: "ok", 1: "insufficient_pre_event_history", 2: "ok", 3: "no_event_date_match", 9: "no_price_data", 10: "price_fetch_error", 11: "price_fetch_error"}
    for cid in (0, 2):
        idx = list(ref.index).index(days[cid])
        est = ref.iloc[idx - 250: idx - 29]
        b, a = np.polyfit(est.m, est.r, 1)
        for label, (lo, hi) in eventstudy.EVENT_WINDOWS.items():
            w = ref.iloc[max(0, idx + lo): idx + hi + 1]
            row = out[(out.catalyst_id == cid) & (out.window_label == label)].set_index("benchmark")
            assert row.loc["MARKET_MODEL", "car"] == pytest.approx((w.r - a - b * w.m).sum(), abs=1e-9)
            assert row.loc["RAW", "raw_return"] == pytest.approx(w.r.sum(), abs=1e-9)
            assert row.loc["XBI", "car"] == pytest.approx((w.r - w.x).sum(), abs=1e-9)


def test_gap_guard_and_short_history(spark):
    bars = _bars(300)
    bars = bars[(bars.date < D(2020, 10, 1)) | (bars.date > D(2020, 10, 20))]
    sbars, wide, _ = _frames(spark, bars.reset_index(drop=True))
    ev = spark.createDataFrame([(1, D(2020, 10, 5), "A")], "catalyst_id int, announcement_date date, ticker string")
    al = series.align(series.simple_returns(sbars), wide)
    m = eventstudy.match_events(ev, eventstudy.session_measures(al), sbars).first()
    assert m["price_status"] == "event_date_outside_price_range"
    short = sbars.limit(60)
    m = eventstudy.match_events(ev, eventstudy.session_measures(series.align(series.simple_returns(short), wide)), short).first()
    assert m["price_status"] == "insufficient_history"


def test_missing_price_is_padded(spark):
    b = spark.createDataFrame([("A", D(2020, 1, 1), 10.0), ("A", D(2020, 1, 2), None), ("A", D(2020, 1, 3), 11.0)],
                              "ticker string, date date, adj_close double")
    got = [r["ret"] for r in series.simple_returns(b).orderBy("date").collect()]
    assert got == [0.0, pytest.approx(0.1)]


def test_trailing_features_use_only_earlier_rows(spark):
    days = pd.bdate_range("2020-01-01", periods=100)
    bars = pd.DataFrame({"ticker": "A", "date": days.date, "adj_close": 100 + 0.5 * np.arange(100), "volume": 1e6})
    bench = pd.DataFrame({"benchmark": "XBI", "date": days.date, "adj_close": 100 * 1.001 ** np.arange(100)})
    wide = series.benchmark_returns(spark.createDataFrame(bench))
    cut = D(2020, 4, 1)
    ev = spark.createDataFrame([(1, "A", cut)], "catalyst_id int, ticker string, cutoff date")
    full = features.market_features(ev, spark.createDataFrame(bars), wide).first()
    early = bars[bars.date < cut]
    assert full["as_of_date"] == early.date.iloc[-1]
    assert full["price_at_cutoff"] == early.adj_close.iloc[-1]
    assert full["return_20d"] == pytest.approx(early.adj_close.iloc[-1] / early.adj_close.iloc[-21] - 1)
    poisoned = bars.copy()
    poisoned.loc[poisoned.date >= cut, ["adj_close", "volume"]] = 1e9
    assert features.market_features(ev, spark.createDataFrame(poisoned), wide).first() == full
    few = features.market_features(ev, spark.createDataFrame(bars[bars.date >= D(2020, 3, 20)]), wide)
    assert few.count() == 0


def test_prior_success_ignores_same_day_and_undated(spark):
    ev = spark.createDataFrame(
        [(1, "d", D(2020, 1, 1), 1), (2, "d", D(2020, 1, 1), 0), (3, "d", D(2020, 1, 2), None), (4, "d", None, 1), (5, "d", D(2020, 1, 3), 1)],
        "catalyst_id int, drug_name string, announcement_date date, clinical_success int")
    got = {r["catalyst_id"]: (r["n_prior_same_drug"], r["prior_success_rate_same_drug"]) for r in features.prior_same_drug(ev).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (2, 0.5), 4: (0, None), 5: (2, 0.5)}
