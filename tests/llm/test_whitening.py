import math

import numpy as np
import pytest

from eventide.llm import whitening as wh
from tests.llm.helpers import CLASHING, empty

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """Exact integer covariance by plain loops over the distinct vectors, then numpy's eigh."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    v = np.array([[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit) / n**3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(v)
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    white = (np.array(x, float) - np.array(s) / n) @ axes[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))
    return n, dev, white, e[::-1] / e.sum()


def check(got, vectors, k=4):
    n, dev, white, share = brute(vectors)
    k = min(k, len(vectors[0]))
    assert len(got) == k * len(vectors)
    for c in range(1, k + 1):
        mine = {r.vec_id: r for r in got if r.component == c}
        w = np.array([mine[i].whitened for i in range(len(vectors))])
        sign = np.sign(w @ white[:, c - 1])
        assert np.allclose(sign * w, white[:, c - 1], rtol=1e-6, atol=1e-6)
        assert [mine[i].deviation for i in range(len(vectors))] == dev and {r.n for r in mine.values()} == {n}
        assert abs(mine[0].explained / share[c - 1] - 1) < 1e-9 and mine[0].identity_error < 1e-9


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    for d in (1, 3, 9):
        vectors = (rng.normal(size=(300, d)) * (1 + np.arange(d)) + 50).astype(np.float32)
        vectors[200:] = vectors[:100]
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
        check(wh.whitened(df).collect(), vectors.tolist())


def test_query_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted(df.collect())
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    check(wh.whitened(df).collect(), [r.embedding for r in rows])


@pytest.mark.parametrize("high", [1, 2, 600, 1 << 20, (1 << 40) + 3, (1 << 62) + 5])
def test_bit_planes_give_exact_products(high):
    rng = np.random.default_rng(high % 1000)
    for n, d in ((1, 1), (64, 3), (130, 5)):
        y = rng.integers(0, high, (n, d), dtype=np.uint64, endpoint=True)
        want = y.astype(object).T @ y.astype(object)
        assert (wh.products(y).astype(object) == want).all()
        x = y.astype(np.int64) - np.int64(high // 2)
        sums, xx = wh._block_sums(x)
        o = x.astype(object)
        assert sums == list(o.sum(axis=0)) and all(xx[i][j - i] == (o.T @ o)[i, j] for i in range(d) for j in range(i, d))
    assert all(sum(v << wh.LIMB * i for i, v in enumerate(wh._limbs(x))) == x for x in (0, 1, -1, 1 << 130, -(1 << 140) + 7))


def test_blocks_and_tasks_add_up(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK", 64)
    x = np.random.default_rng(2).integers(-900, 900, (1000, 4))
    df = spark.createDataFrame([(bytearray(b),) for b in wh._packed(x)], "x binary").repartition(7)
    m = wh.moments(df, 4)
    o = x.astype(object)
    assert m.n == 1000 and m.sums == list(o.sum(axis=0)) and (np.array(m.scatter, object) == 1000 * (o.T @ o) - np.outer(o.sum(axis=0), o.sum(axis=0))).all()


def test_packing_round_trip():
    import pyarrow as pa

    x = np.array([[1, -2], [127, 128], [-32768, 5], [1 << 20, 0], [-(1 << 63), (1 << 63) - 1]])
    packed = wh._packed(x)
    assert [len(p) for p in packed] == [2, 4, 4, 8, 16] and (wh._unpacked(pa.array(packed, pa.binary()), 2) == x).all()
    assert wh.whole_numbers(np.array([-1e-9, 0.5, -0.5, 3e38, -3e38, -0.0])).tolist() == [-1, 128, -128, (1 << 63) - 1, -(1 << 63), 0]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [3.0, -1.0], 0), (4, None, 0), (5, [], 0), (6, [1.0], 0),
        (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [0.5, 0.25], None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = wh.whitened(df.withColumns({c: F.lit("clash") for c in (*CLASHING, "deviation", "component")})).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 10) for c in (1, 2))
    assert {r.n for r in got} == {3} and got[0].identity_error < 1e-9
    assert wh.whitened(empty(spark, SCHEMA)).count() == 0 and wh.whitened(df.filter("vec_id in (4, 5)")).count() == 0
    flat = wh.whitened(df.filter("vec_id in (1, 2)")).collect()
    assert len(flat) == 6 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(0.0, 0.0, 0, 1.0)}
    line = wh.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, -1.0 * i], 0) for i in range(9)], SCHEMA)).collect()
    assert {(r.component, round(r.explained, 9)) for r in line} == {(1, 1.0), (2, 0.0), (3, 0.0)} and {r.whitened for r in line if r.component > 1} == {0.0}
    huge = wh.whitened(spark.createDataFrame([(i, [1e30 * (i - 1), 3e38], 0) for i in range(3)], SCHEMA)).collect()
    assert {r.deviation for r in huge} == {None, 0} or None in {r.deviation for r in huge}
