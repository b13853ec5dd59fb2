import random
import zlib

import numpy as np
import pyarrow as pa

from eventide.llm import language, quality, toxicity
from tests.llm.helpers import awkward, empty, labels

RNG = random.Random(8)
CLEAN = ["river", "stone", "garden", "window", "letter", "market", "summer", "winter", "paper", "silver", "morning", "carpet"]


def text(words, n):
    return " ".join(RNG.choice(words) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_subword_bags_reach_unseen_misspellings():
    bad = ["vilekrat", "vilekrot", "vilekrans", "vilekrit"]
    docs, y = [], []
    for i in range(300):
        t = text(CLEAN, RNG.randint(5, 200)).split()
        if i % 2:
            t[RNG.randrange(len(t))] = RNG.choice(bad)
        docs.append(" ".join(t))
        y.append(i % 2)
    model = toxicity.fit(pa.array(docs), np.array(y))

    def odds(t):
        _, _, data, offsets = next(toxicity.tk.chunks(pa.array([t])))
        return toxicity.word_scores(model, data, offsets)[0].max()

    assert odds(text(CLEAN, 5000) + " Vilekrumm") > 0 > odds(text(CLEAN, 5000))


def test_scores_take_awkward_rows(spark):
    df = awkward(spark)
    for out in (toxicity.scores(df, toxicity.train(df, labels(spark))), quality.scores(df, labels(spark))):
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
        for r in rows:
            assert 0 <= r.score <= 1 and r.predicted in (0, 1)
            assert r.held_out == (held(r.doc_id) if r.doc_id is not None else None)
    none = labels(spark, [(1, None, None)])
    assert toxicity.scores(empty(spark), toxicity.train(df, none)).count() == 0
    assert quality.scores(empty(spark), none).count() == 0
    assert {r.score for r in quality.scores(df, none).collect()} == {0.5}


def test_quality_holds_out_and_learns(spark):
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, (". ".join(text(CLEAN, 9) for _ in range(RNG.randint(2, 9))) + ".") if good else RNG.choice(CLEAN[:3] + ["###"]) * 2 + (" spam" * RNG.randint(10, 90))))
        marks.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.scores(docs, labels(spark, marks)).filter("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in got]) > 0.97
    # labels of fold 0 have no influence
    turned = [(i, 1 - q if held(i) else q, 0) for i, q, _ in marks]
    again = {r.doc_id: r.score for r in quality.scores(docs, labels(spark, turned)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(2)
    x = [rng.standard_normal((300, 3)) @ rng.standard_normal((3, 3)), rng.standard_normal((500, 3)) + 1]
    n, s, p = np.array([300.0, 500.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x])
    model = quality.discriminant(n, s, p, 0.1)

    def log_density(v, c):
        cov = np.linalg.inv(model.whiten[c]) @ np.linalg.inv(model.whiten[c]).T
        d = v - model.means[c]
        return -0.5 * (np.linalg.slogdet(cov)[1] + d @ np.linalg.inv(cov) @ d) + np.log((n[c] + 1) / (n.sum() + 2))

    assert np.allclose(model.log_odds(x[0][:5]), [log_density(v, 1) - log_density(v, 0) for v in x[0][:5]])


def test_language(spark):
    words = {"aa": ["rakata", "tarako", "karat"], "bb": ["süölü", "lüsö", "ösül"], "cc": ["minimi", "nimin", "imim"]}
    rows = [(i, text(words[lang], RNG.randint(4, 40)), lang) for i in range(300) for lang in [RNG.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predictions(docs, language.train(docs)).filter("held_out").collect()
    truth = {i: lang for i, _, lang in rows}
    assert got and all(r.lang_pred == truth[r.doc_id] and not r.rejected for r in got)
    far = language.predictions(spark.createDataFrame([(1, "zzqq xxyy " * 9, "aa")], docs.schema), language.train(docs)).first()
    assert far.rejected


def test_language_takes_awkward_rows(spark):
    df = awkward(spark)
    got = {r.doc_id: r for r in language.predictions(df, language.train(df)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 8))
    assert all(got[i].lang_pred != "und" and 0 < got[i].score <= 1 for i in (1, 6, 7, None))
    assert language.predictions(empty(spark), language.train(df)).count() == 0
    assert {r.lang_pred for r in language.predictions(df, language.train(empty(spark))).collect()} == {"und"}


def test_letters_of_any_script():
    assert language.has_letter(pa.array(["abc", "12 ½", "日", None, "", "é", "!\u0301"])).tolist() == [True, False, True, False, False, True, False]


def test_hot_ids_do_not_grow_the_samples(spark):
    words = "the quick brown fox jumps over lazy dogs while every good clerk writes".split()
    rows = [(1, f"{words[i % 12]} {words[i * 7 % 12]} hot {i}", "en", None, None) for i in range(3000)] + [(2, "the same row again", "de", None, None)] * 3000
    rows += [(i, f"{words[i % 12]} text {i}", "en" if i % 2 else "de", None, None) for i in range(3, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 400)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, marks, "toxic", 50, 80)
    assert got.count() == 130
    sample = language._sample(language.learnable(docs), 60).groupBy("lang").count().collect()
    assert {r["lang"] for r in sample} == {"en", "de"} and all(r["count"] <= 60 for r in sample)
    long = spark.createDataFrame([(6, "x" * 30, "en"), (7, "short", "en")], "doc_id long, text string, lang string")
    assert [r.text for r in language._sample(long, 5, most_chars=10).collect()] == ["short"]
