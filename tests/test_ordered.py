"""Order-dependent operators on skewed frames, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import metrics
from eventide.operators.ordered import numbered, order_statistics, percent_ranks, quantiles, running


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, a third of those on one value."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(list("abc"), n))
    v = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.normal(size=n), 3))
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


def test_numbered_matches_pandas(spark, skewed):
    out = numbered(spark.createDataFrame(skewed), ["g"], [F.col("v").desc(), F.col("id").asc()], totals=True).toPandas()
    ref = skewed.sort_values(["v", "id"], ascending=[False, True])
    ref["row_no"] = ref.groupby("g").cumcount() + 1
    both = out.merge(ref, on="id", suffixes=("", "_ref"))
    assert (both.row_no == both.row_no_ref).all()
    assert (both.row_no_total == both.groupby("g").id.transform("count")).all()


def test_running_sum_and_max(spark, skewed):
    out = running(spark.createDataFrame(skewed), [], ["v", "id"], sums={"s": "v"}, maxes={"m": "id"}).toPandas()
    ref = skewed.sort_values(["v", "id"]).assign(s=lambda d: d.v.cumsum(), m=lambda d: d.id.cummax())
    both = out.merge(ref, on="id", suffixes=("", "_ref"))
    assert len(both) == len(skewed)
    assert np.allclose(both.s, both.s_ref) and (both.m == both.m_ref).all()


def test_quantiles_match_numpy(spark, skewed):
    out = quantiles(spark.createDataFrame(skewed), ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).toPandas().set_index("g")
    for g, d in skewed.groupby("g"):
        assert np.allclose(out.loc[g, ["q1", "q2", "q9"]].astype(float), np.percentile(d.v, [25, 50, 90]))


def test_upper_median(spark, skewed):
    out = order_statistics(spark.createDataFrame(skewed), ["g"], "v", {"m": lambda n: F.floor(n / 2).cast("long")})
    for r in out.collect():
        d = sorted(skewed[skewed.g == r["g"]].v)
        assert r["m"] == d[len(d) // 2]


def test_percent_ranks_average_ties(spark, skewed):
    frame = skewed.copy()
    frame.loc[frame.id % 50 == 0, "v"] = None
    out = percent_ranks(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, g string, v double"),
                        ["g"], "v", "p").toPandas().set_index("id").p
    ref = frame.set_index("id").groupby("g").v.rank(pct=True)
    assert np.allclose(out.sort_index(), ref.sort_index(), equal_nan=True)


def test_conformal_quantile_is_the_higher_one(spark):
    res = [-0.05, 0.03, -0.02, 0.04, -0.01]
    df = spark.createDataFrame([(r,) for r in res], "residual double")
    q = metrics.conformal_quantile(df, "residual").first()["q"]
    a = np.abs(res)
    level = min(1.0, np.ceil((len(a) + 1) * 0.9) / len(a))
    assert q == np.quantile(a, level, method="higher")


def test_rank_metrics_by_brute_force(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp, k = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        ap += (tp - seen) / y.sum() * tp / k
        seen = tp
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)
    one = df.withColumn("y", F.lit(1))
    assert metrics.roc_auc(one, "y", "p").first()[0] is None


def test_student_t_known_values():
    assert metrics.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert metrics.student_t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-10)
    assert metrics.student_t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_reliability_and_calibration_guards(spark):
    few = spark.createDataFrame([(1, 0.5), (0, 0.4)], "y int, p double")
    assert metrics.reliability_bins(few, "y", "p").count() == 0
    row = metrics.calibration_line(few, "y", "p").first()
    assert row[0] is None and row[1] is None
