import random

import numpy as np

from eventide.llm import decontamination as dec
from tests.llm.helpers import awkward, empty


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdeé日")]
    return "".join(text)


def test_equals_full_edit_distance(spark):
    rng = random.Random(6)
    letters = "abcdefgh éüñ"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(30, 120))).strip()) for i in range(6)]
    docs = []
    for i in range(60):
        item = rng.choice(items)[1]
        filler = "".join(rng.choice(letters) for _ in range(80))
        docs.append((i, filler[:40] + " " + edited(rng, item, rng.randint(0, len(item) // 5)).upper() + "\n\n" + filler[40:]))
    docs += [(100 + i, "".join(rng.choice(letters) for _ in range(300))) for i in range(10)]
    # non-ASCII letters are compared as they are
    docs = [(i, "".join(c if not c.isascii() or not c.isalpha() else c for c in t).replace("É", "é").replace("Ü", "ü").replace("Ñ", "ñ")) for i, t in docs]
    want = set()
    for i, text in docs:
        for j, item in items:
            item = dec.normal_text(item)
            budget = min(len(item) // 10, len(item) // dec.HEAD - 1)
            if (d := distance(item, dec.normal_text(text))) <= budget:
                want.add((i, j, d))
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=150).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 20


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, None), (3, ""), (4, "   "), (5, "12345 !"), (6, "a row without an id"), (None, "quick brown fox")], "item_id long, text string")
    got = dec.contaminated(awkward(spark), items).collect()
    assert sorted([(r.doc_id, r.item_id) for r in got], key=str) == sorted([(1, 1), (2, 1), (2, 1), (None, 6)], key=str)
    kept = dec.clean_documents(awkward(spark), items)
    assert kept.columns == awkward(spark).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 6, 7, 8]
    assert dec.contaminated(empty(spark), items).count() == 0
    assert dec.contaminated(awkward(spark), items.limit(0)).count() == 0


def test_short_item_matches_a_whole_text_only(spark):
    docs = spark.createDataFrame([(1, " Abc  D "), (2, "abc d e")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "abc d")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect()] == [(1, 9)]


def found_in(text, index):
    data = np.frombuffer(text.encode(), np.uint8)
    return [(n, d) for _, n, d, _ in dec.matches(data, np.array([0, len(data)]), index, {})]


def test_pieces_alone_and_pieces_of_a_known_passage_are_not_verified(monkeypatch):
    """Edit distances are computed around few hits: not where a piece stands alone, and not for each piece of a passage."""
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghijklmnopq éü") for _ in range(300)).replace("  ", "a ").strip()
    index = dec.pieces([(1, item)], 0.1)
    _, item, k = index.items[0]
    calls, best = [], dec.Myers.best
    monkeypatch.setattr(dec.Myers, "best", lambda self, text: (calls.append(text), best(self, text))[1])
    alone = " ".join(item[len(item) * i // (k + 1) : len(item) * (i + 1) // (k + 1)] + " zzzz zzzz zzzz zzzz zzzz zzzz" for i in range(k + 1))
    assert found_in(alone, index) == [] and len(index.bodies) > 20 and calls == []
    assert found_in("zz " + item + " zz", index) == [(0, 0)] and len(calls) < 10


def test_passages_within_the_budget_are_found_wherever_their_edits_lie():
    """As many edits as the budget has, spread or in one place, of characters of one to four bytes."""
    rng = random.Random(8)
    for _ in range(150):
        item = dec.normal_text("".join(rng.choice("abcd éü日😀") for _ in range(rng.randint(60, 200))))
        index = dec.pieces([(1, item)], 0.1)
        k = index.items[0][2]
        at = rng.randrange(len(item) // 2)
        text = item[:at] + edited(rng, item[at : at + rng.choice((2 * k, len(item)))], k) + item[at + len(item) :]
        text = dec.normal_text("xxxx " + edited(rng, item, k) + " yyyy " + text + " zzzz")
        want = distance(item, text)
        assert found_in(text, index) == ([(0, want)] if want <= k else []) and k > 5


def test_clean_documents_are_judged_where_they_are(spark):
    """No copy, shuffle or join of the documents, and the same rows in one block or several."""
    items = spark.createDataFrame([(i, f"item number {i} of the benchmark has its own words w{i * 7} and x{i * 13}") for i in range(6)], "item_id long, text string")
    docs = [(i % 5 or None, f"before {'it' if i % 3 else f'item number {i % 6} of the benchmark has its own words w{i % 6 * 7} and x{i % 6 * 13}'} after", i) for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, more long").repartition(3)
    want = [i for i in range(30) if i % 3]
    for block_chars in (10_000, 100):
        kept = dec.clean_documents(docs, items, block_chars=block_chars)
        assert kept.columns == docs.columns and sorted(r.more for r in kept.collect()) == want
    plan = dec.clean_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), items)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan
