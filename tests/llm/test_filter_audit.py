import itertools
import math
from collections import Counter

import numpy as np

from eventide.llm import filter_audit as fa
from tests.llm.helpers import awkward, empty, labels

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, marks):
    """Every order applied to every document, one after another."""
    rows = [(i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))

    def failed(i, t):
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        upper = sum("A" <= c <= "Z" for c in t)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * upper > 2 * len(t) else set()
        out |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        return out | ({"E"} if i is not None and i > first[t] else set())

    judged = [(i, s, failed(i, t)) for i, t, s in rows]
    out, shapley = {}, Counter()
    for part in {s for _, s, _ in judged}:
        here = [(i, f) for i, s, f in judged if s == part]
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                gone = [r for r in here if r not in left]
                left = [(i, f) for i, f in left if x not in f]
                shapley[part, x] += len(removed)
                out[part, "".join(order), step] = (
                    len(left), len(removed), sum(x in f for _, f in here) - len(removed), sum(f == {x} for _, f in here),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                )
                assert gone is not None
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert len(out) == df.count()
    return out


def documents():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)] + ["The", "UPPER", "a#b", "50%"]
    weights = np.array([1.0] * 400 + [3, 1, 0.05, 0.05])
    texts = [" ".join(rng.choice(words, int(n), p=weights / weights.sum())) for n in rng.integers(1, 900, 150)] + [None, "", "same text " * 120]
    rows = [(int(i), texts[int(t)], ("a", "b", None)[int(s)]) for i, t, s in zip(rng.permutation(400), rng.integers(0, 153, 400), rng.integers(0, 3, 400), strict=True)]
    return rows + [(None, texts[0], "a"), (None, texts[0], "b"), rows[0], rows[0], (rows[1][0], "another text", "c"), (rows[1][0], texts[3], "c")]


def test_equals_brute_force_with_ids_and_copies(spark):
    docs = documents()
    marks = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 400, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    got = rows_of(fa.interactions(df, labels(spark, marks)))
    want = brute(docs, marks)
    assert len(got) == 600 * 4 and got == want


def test_hot_copies_and_hot_ids(spark):
    docs = [(i, "one text on a third of all rows", "hot") for i in range(500)] + [(7, f"text {i}", "id") for i in range(500)] + [(i, f"alone {i}", "c") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(8)
    got = rows_of(fa.interactions(df, labels(spark, [(7, 1, 1)])))
    assert got["hot", "EABCD", 1][:2] == (1, 499) and got["id", "EABCD", 1][:2] == (500, 0) and got["id", "AEBCD", 1][4:6] == (500, 500)
    assert got["hot", "AEBCD", 2][:3] == (0, 0, 499) and got["hot", "AEBCD", 2][6] == 499 * sum(
        math.factorial(r) * math.factorial(4 - r) * math.comb(3, r) for r in range(4)
    )


def test_sketch_clears_unique_texts_only(spark):
    n = 3000
    facts = spark.range(n).selectExpr("id as doc_id", "xxhash64(id % 2900) as k1", "xxhash64(id % 2900, 5) as k2").repartition(5)
    for cells in (1 << 16, 1 << 12, 1 << 9 << 3):
        bitmap = fa.repeat_bitmap(facts, cells)
        possible = {r.doc_id for r in fa._sieve(facts, bitmap, True).collect()}
        clear = {r.doc_id for r in fa._sieve(facts, bitmap, False).collect()}
        assert possible | clear == set(range(n)) and not possible & clear
        assert {i for i in range(n) if i % 2900 < 100} <= possible
        assert cells < 1 << 16 or len(possible) < 250


def test_long_texts_are_counted_by_slices(monkeypatch):
    raw = b"a bb  a\tccc\n" * 50 + b"dddddddddddddddddddddd" * 9 + b" a"
    whole = fa.word_counts(raw)
    monkeypatch.setattr(fa, "_SLICE", 7)
    assert fa.word_counts(raw) == whole == (len(raw.split()), len(set(raw.split()))) and fa.word_counts(b"") == (0, 0)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    marks = [tuple(r) for r in labels(spark).collect()]
    assert rows_of(fa.interactions(df, labels(spark))) == brute(rows, marks)
    assert fa.interactions(empty(spark), labels(spark)).count() == 0
    assert fa.interactions(df, empty(spark, "doc_id long, quality int, toxic int")).count() == 600 * 4
