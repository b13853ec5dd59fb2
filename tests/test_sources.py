"""Landed files and bundles: quoting, file order, unique keys."""

import pyspark.sql.functions as F

from eventide.operators import registry, studies
from eventide.sources import bars, sinks


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "abc.csv").write_text('"Date", "Open",High,"Adj Close",Volume,Note\n2020-01-02,"1",2,"1.5",10,"a, ""b"""\n2020-01-03,3,,4,\n')
    (tmp_path / "bad.csv").write_text("<html>\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    got = {str(r.date): r for r in bars.read_local_csv(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got["2020-01-02"].ticker == "ABC"
    assert (got["2020-01-02"].open, got["2020-01-02"].adj_close, got["2020-01-02"].volume) == (1.0, 1.5, 10.0)
    assert (got["2020-01-03"].high, got["2020-01-03"].adj_close, got["2020-01-03"].volume) == (None, 4.0, None)
    cells = spark.sql("select 1 as x").select(bars._cells(F.lit('"a, ""b""",,c,')).alias("c")).first()["c"]
    assert cells == ['a, "b"', "", "c", ""]


def test_bundle_keys_are_unique(spark):
    b = spark.createDataFrame([(1, "x", "X", "d", "i", None, "N", 1, None)], "program_id int, ticker string, company_name string, drug_name string, indication string, t0_date date, nct_id string, clinical_success int, event_date date")
    s = spark.createDataFrame([(1, 7, "mouse", 0.1), (1, 7, "mouse", 0.2), (1, 7, "rat", 0.1), (1, 8, None, None)], "program_id int, pmid int, species string, effect_size double")
    tables = sinks.bundle_tables(b, s)
    a, f = tables["animal_studies"], tables["animal_study_features"]
    assert a.select("study_id").distinct().count() == 4
    assert {(r.species, r.effect_size) for r in a.join(f, "study_id").collect()} == {("mouse", 0.1), ("mouse", 0.2), ("rat", 0.1), (None, None)}


def test_latest_snapshot_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (1, 4, "z")], "k int, t int, p string")
    assert registry.latest_snapshot(df, "k", "t", "p").first()["p"] == "c"


def test_only_verified_studies_count(spark):
    df = spark.createDataFrame([("verified",), ("pending",), ("rejected",), (None,)], "verification_status string")
    assert studies.verified(df).count() == 1


def test_a_landing_reads_its_own_partitions_only(spark, tmp_path):
    import datetime as dt

    from eventide import schemas
    from eventide.streaming import ingest

    names = [f.split()[0] for f in schemas.BARS.split(", ")]

    def bars(rows):
        full = [tuple({"ticker": t, "date": d, "provider": p}.get(n, 1.0) for n in names) for t, d, p in rows]
        return spark.createDataFrame(full, schemas.BARS)

    path = str(tmp_path / "store")
    first = [(t, dt.date(y, 1, d), p) for t in "AB" for y in (2001, 2002, 2003) for d in (2, 3) for p in ("x", "y")]
    ingest.append_new_bars(bars(first), path)
    batch = bars([("A", dt.date(2002, 1, 3), "x"), ("A", dt.date(2002, 1, 9), "x"), ("A", dt.date(2002, 1, 9), "x")])
    read = ingest.stored_keys(ingest.open_store(spark, path), ingest.touched_partitions(batch))
    assert {f.split("/store/")[1].rsplit("/", 1)[0] for f in read.inputFiles()} == {"provider=x/bar_year=2002"} or "PartitionFilters" in read._jdf.queryExecution().toString()
    assert sorted(r.date.day for r in read.collect()) == [3, 3]
    for _ in range(2):  # a replay adds nothing
        ingest.append_new_bars(batch, path)
        assert ingest.open_store(spark, path).count() == len(first) + 1
    ingest.append_new_bars(bars([]), path)
    assert ingest.open_store(spark, path).count() == len(first) + 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bar_year" in plan.split("PartitionFilters: [")[1]
