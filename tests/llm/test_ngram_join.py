import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import ngram_join
from eventide.llm.id_filter import BITS, id_bitmap, wanted
from eventide.llm.tables import small_batches
from tests.llm.helpers import awkward, empty


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    least = list(range(len(rows)))

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                least[max(find(i), find(j))] = min(find(i), find(j))
    group = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            group[find(i)] = min(d, group.get(find(i), d))
    return sorted([(d, len(sets[i]), group[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)], key=str)


def made(seed=4, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        if rng.random() < 0.5:
            base[5:5] = common
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MEMBERS", 2)
    rows = made()
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted([tuple(r) for r in ngram_join.similar_components(df).collect()], key=str) == brute(rows)
    assert ngram_join.similar_components(empty(spark)).count() == 0


def test_bitmap_bound_never_undercounts():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        tokens, of = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        bits, size = ngram_join.parity_bitmaps(tokens, of, 2), np.array([len(a), len(b)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 10 * (len(a) + len(b) - both):
            assert ngram_join.may_link(size, bits, np.array([0]), np.array([1]), 10).all()


def test_members_follow_from_leaders():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    x, y = pool[:100], pool[12:112]
    member = {"lacks": x[:12].tobytes(), "adds": pool[100:112].tobytes()}
    assert not ngram_join._any_link(x.tobytes(), y.tobytes(), None, None, 80)
    assert ngram_join._any_link(x.tobytes(), y.tobytes(), [member], None, 80)
    assert ngram_join._any_link(y.tobytes(), x.tobytes(), None, [member], 80)


def test_frequent_tokens_of_a_window_take_little_more_than_the_window():
    rng = np.random.default_rng(3)
    window = [np.concatenate([rng.integers(0, 2000, 5_000), rng.integers(0, 1 << 62, 45_000)]).astype(np.uint64) for _ in range(20)]
    values, count = np.unique(np.concatenate(window), return_counts=True)
    keep = count >= ngram_join.SEEN
    tracemalloc.start()
    tokens, seen = ngram_join.frequent(window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tokens == values[keep]).all() and (seen == count[keep]).all() and not window
    assert peak < 1.5 * 8_000_000  # sorted copies, places and counts took four times the window
    assert len(ngram_join.frequent([])[0]) == len(ngram_join.frequent([np.ones(2, np.uint64)])[0]) == 0


def test_units_are_linked_a_row_at_a_time():
    tokens = np.arange(100, dtype=np.uint64)
    one, other = tokens[:60].tobytes(), tokens[40:].tobytes()  # the leaders share 20 of 100 tokens
    near = {"lacks": b"", "adds": tokens[60:].tobytes()}  # this member of the first one holds all tokens
    full = {"lacks": b"", "adds": tokens[:40].tobytes()}
    far = [{"lacks": b"", "adds": np.arange(1000 + i, 1002 + i, dtype=np.uint64).tobytes()} for i in range(64)]
    n = 2000
    lists = pa.list_(pa.struct([("lacks", pa.binary()), ("adds", pa.binary())]))
    rows = {"list_a": [far] * n + [[near], None], "list_b": [None] * n + [[full], None]}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n + 2)), pa.array(range(n + 2)), pa.array([one] * (n + 2)), pa.array([other] * (n + 2)),
         pa.array(rows["list_a"], lists), pa.array(rows["list_b"], lists)], ["ua", "ub", "ta", "tb", "list_a", "list_b"])
    del rows
    tracemalloc.start()
    linked = ngram_join.linked_units(batch, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert linked.to_pydict() == {"ua": [n], "ub": [n]}
    assert peak < 1 << 20, peak  # the members of all rows as Python values take 30 times as much


def test_python_gets_small_batches_and_the_setting_comes_back(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (seen.append(spark.conf.get(key)), real(df, name))[1])
    docs = spark.range(40).selectExpr("id doc_id", "repeat(concat('word', id % 4, ' '), 40000) text")
    with small_batches(spark):
        sizes = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) < 6 << 20  # 9 MB in all
    assert len({r.component_id for r in ngram_join.similar_components(docs).collect()}) == 4
    assert seen and set(seen) == {"4m"} and spark.conf.get(key) == before


def test_bitmap_of_ids_is_a_bit_each(spark):
    ids = np.array([0, 1, 7, -5, 2**62, -(2**63)])
    bitmap = id_bitmap(spark.createDataFrame([(int(i),) for i in ids], "id long"), "id")
    assert bitmap.nbytes == BITS // 8
    assert wanted(bitmap, ids).all() and not wanted(bitmap, np.arange(100, 200)).any()


def test_pairs_of_a_group_of_near_copies_follow_its_size(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(500):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 2, 3, 3))):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    counts, written = [], ngram_join.written

    def counted(df, name):
        out = written(df, name)
        if name == "unit_pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert sum(counts) <= 4 * len(rows), counts  # 18,015 when all pairs were answered at once


def test_likeliest_pairs_cover_every_component():
    comp = np.array([1, 1, 2, 3, 3, 4])
    pairs = np.array([[0, 1, 0, 2, 2], [2, 2, 3, 4, 5], [5, 9, 1, 3, 0]])
    assert ngram_join._likeliest(comp, pairs, 1).tolist() == [[1, 2, 2], [2, 4, 5], [9, 3, 0]]
    assert ngram_join._likeliest(comp, pairs, 9).tolist() == pairs.tolist()
    assert ngram_join._likeliest(comp, pairs[:, :0], 1).shape == (3, 0)
