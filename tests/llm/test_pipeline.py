import corpus_pipeline
from eventide.llm import decontamination, ngram_join, quality
from eventide.llm.tables import table
from tests.llm.helpers import awkward, empty

SF = "/root/testdata/sf0.001"


def test_stages_filter_what_they_name(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").isEmpty()
        counts.append(docs.count())
        if name == "n-gram Jaccard join":
            assert ngram_join.similar_components(docs).filter("doc_id <> component_id").isEmpty()
    assert decontamination.contaminated(docs, table(spark, SF, "benchmark")).isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] > counts[0] / 2


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert not got.duplicated(["doc_id", "start"]).any() and (got["offset"] + got["length"] <= 2048).all()


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark)
    got = corpus_pipeline.distinct_documents(spark, docs, SF)
    assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    a, b, near = (" ".join(f"{c}{i}" for i in range(60)) for c in ("a", "b", "b"))
    rows = [(5, b), (5, b), (5, a), (9, near + " end"), (None, a), (None, "c d e f g h"), (None, "c d e f g h"), (None, None), (None, None), (1 << 40, a)]
    rows += [(7, "hot row of the table")] * 50
    got = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), SF)
    want = [(5, a), (5, b), (None, "c d e f g h"), (None, None), (None, None), (7, "hot row of the table")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.distinct_documents(spark, empty(spark), SF).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    data = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    model = corpus_pipeline.toxicity.train(data, labels)
    bad = corpus_pipeline.toxicity.scores(data, model).filter("predicted = 1").first().doc_id
    junk = corpus_pipeline.quality.scores(data, labels).filter("predicted = 0 and score < 0.2").first().doc_id
    leak = table(spark, SF, "benchmark").filter("length(text) > 50").first().text
    texts = {r.doc_id: r.text for r in data.filter(data.doc_id.isin(bad, junk)).collect()}
    for name, text in (("toxicity", texts[bad]), ("quality classifier", texts[junk]), ("benchmark decontamination", leak)):
        stage = dict(corpus_pipeline.STAGES)[name]
        # at ids without a label, so that the models stay as they are
        more = awkward(spark, extra=False).limit(0).union(spark.createDataFrame([(None, text, "", "", 1), (-5, text, "", "", 1), (-5, "", "", "", 1), (-5, text, "", "", 1)], awkward(spark, extra=False).schema))
        docs = data.select(more.columns).union(more)
        got = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert got.columns == docs.columns and got.count() > docs.count() / 2
        assert got.filter(got.text == text).isEmpty(), name
        if name != "quality classifier":
            assert got.filter("doc_id = -5").count() == 1, name
        assert stage(spark, awkward(spark), SF).columns == awkward(spark).columns
        assert stage(spark, empty(spark), SF).count() == 0


def test_stages_hand_out_small_batches_and_quality_chains_no_workers(spark, monkeypatch):
    key, names = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, real = spark.conf.get(key), quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: (names.append(name), real(df, name))[1])
    try:
        docs = corpus_pipeline.good_quality(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001")
        assert names == ["statistics"] and docs.count()  # read back before the moments, which are Python's too
        assert spark.conf.get(key) == "4m"
    finally:
        spark.conf.set(key, before)
