import numpy as np

from eventide.llm import embedding_dedup


def brute(rows, cosine=0.9):
    ids = [i for i, v in rows]
    unit = []
    for i, v in rows:
        good = i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        a = np.array(v, np.float32).astype(float) if good else None
        unit.append(a / np.linalg.norm(a) if good else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], len(near[i]), min(ids[j] for j in seen) if ids[i] is not None else None))
    return sorted(out, key=str)


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df, **options).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_clusters_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(x) for x in (centre + rng.standard_normal(16) * s)]) for k, s in enumerate((0, 0.1, 0.3, 0.5, 0.6, 0.9))]
    copy = rows[0][1]
    rows += [(100, copy), (101, copy), (102, [2 * x for x in copy]), (103, None), (104, []), (105, [0.0] * 16), (106, [float("nan")] + copy[1:])]
    rows += [(107, [None] + copy[1:]), (108, [float("inf")] + copy[1:]), (109, copy[:8]), (110, copy[:8]), (None, copy)]
    compare(spark, rows)


def test_buckets_larger_than_a_block(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(8) * 0.35]) for i in range(150)]
    compare(spark, rows, block=20)


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, h string")).count() == 0


def test_plan_keeps_recall():
    for n in (10, 10**4, 10**7):
        bits, tables = embedding_dedup.table_plan(n, 0.9, 512, 0.9999)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.9999
