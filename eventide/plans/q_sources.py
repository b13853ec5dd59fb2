"""Queries: landed file readers and sinks. Inputs are written by Spark from the supplied tables into the
shared staging folder, then read back through the sources under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions.rounding import rnd
from eventide.operators import lookup
from eventide.plans import inputs
from eventide.plans.oracle_base import BARS, EVTS, r
from eventide.session import staging_path
from eventide.sources import bars as price_files
from eventide.sources import documents, sinks

QUERIES, ORACLE = {}, {}

TICKER_DIR = r"ticker=([^/]+)/"


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def _daily(spark, sf):
    """Bars with a ticker that is safe in folder names."""
    b = inputs.bars(spark, sf)
    return b.withColumn("ticker", F.concat(F.lit("b"), F.substring("ticker", 7, 3)))


def _lines(df, path):
    df.select("ticker", "value").write.mode("overwrite").partitionBy("ticker").text(path)
    return path


def _stage_csv(spark, sf, header, with_adj):
    """One headered CSV per ticker; the header spelling and the presence of an adjusted close vary."""
    b = _daily(spark, sf)
    d, num = F.date_format("date", "yyyy-MM-dd"), lambda c: F.col(c).cast("string")
    cells = [d, num("low"), num("high"), num("low"), num("adj_close")] + ([num("high")] if with_adj else []) + [num("volume")]
    body = b.select("ticker", F.lit(1).alias("o"), d.alias("k"), F.concat_ws(",", *cells).alias("value"))
    head = b.select("ticker").distinct().select("ticker", F.lit(0).alias("o"), F.lit("").alias("k"), F.lit(header).alias("value"))
    one = body.unionByName(head).repartition("ticker").sortWithinPartitions("ticker", "o", "k")
    return _lines(one, staging_path(spark, "csv")) + "/*/*"


def _bars_out(df, extra=()):
    return df.select("ticker", F.col("date").cast("string"), rnd("close", 4).alias("close"), rnd("adj_close", 4).alias("adj_close"),
                     "volume", "provider", *extra)


def _bars_sql(adj, provider, where="true"):
    return f"""WITH {BARS} SELECT 'B' || substr(ticker, 7) AS ticker, CAST(date AS VARCHAR) AS date, {r('adj_close', 4)} AS close,
  {r(adj, 4)} AS adj_close, volume, '{provider}' AS provider FROM bars WHERE {where}"""


@register("src_local_csv", _bars_sql("high", "local_csv"))
def src_local_csv(spark, sf):
    path = _stage_csv(spark, sf, " Date ,Open,High,Low,Close,Adj Close,Volume", True)
    return _bars_out(price_files.read_local_csv(spark, path, TICKER_DIR))


@register("src_stooq", _bars_sql("adj_close", "stooq"))
def src_stooq(spark, sf):
    return _bars_out(price_files.read_stooq(spark, _stage_csv(spark, sf, "Date,Open,High,Low,Close,Vol", False), TICKER_DIR))


@register("src_polygon", _bars_sql("adj_close", "polygon", "ticker <> 'Brand#3'"))
def src_polygon(spark, sf):
    """Daily payloads per ticker; one ticker's payload is an error and yields nothing."""
    bar = F.struct((F.unix_date("date").cast("long") * 86400000).alias("t"), F.col("low").alias("o"), F.col("high").alias("h"),
                   F.col("low").alias("l"), F.col("adj_close").alias("c"), F.col("volume").alias("v"))
    docs = _daily(spark, sf).groupBy("ticker").agg(F.collect_list(bar).alias("results"))
    status = F.when(F.col("ticker") == "b3", "ERROR").otherwise("OK").alias("status")
    path = _lines(docs.select("ticker", F.to_json(F.struct(status, "results")).alias("value")), staging_path(spark, "polygon"))
    return _bars_out(price_files.read_polygon(spark, path + "/*/*", TICKER_DIR))


@register("src_eodhd", _bars_sql("CASE WHEN volume > 100 THEN high ELSE adj_close END", "eodhd"))
def src_eodhd(spark, sf):
    """The adjusted close is absent from some objects."""
    cells = F.create_map(F.lit("date"), F.date_format("date", "yyyy-MM-dd"), F.lit("close"), F.col("adj_close").cast("string"),
                         F.lit("volume"), F.col("volume").cast("string"))
    full = F.map_concat(cells, F.create_map(F.lit("adjusted_close"), F.col("high").cast("string")))
    docs = _daily(spark, sf).withColumn("m", F.when(F.col("volume") > 100, full).otherwise(cells)).groupBy("ticker").agg(
        F.collect_list("m").alias("a"))
    path = _lines(docs.select("ticker", F.to_json("a").alias("value")), staging_path(spark, "eodhd"))
    return _bars_out(price_files.read_eodhd(spark, path + "/*/*", TICKER_DIR))


@register("src_vendor_frame", _bars_sql("high", "yfinance").replace("'B' ||", "'b' ||"))
def src_vendor_frame(spark, sf):
    """Frames landed as Parquet under vendor headers, some of them tuples."""
    d = _daily(spark, sf).withColumnsRenamed({"date": "Date", "adj_close": "('Close', 'X')", "high": "Adj Close", "volume": "('Volume', '')"})
    path = staging_path(spark, "frame")
    sinks.refresh(d, path)
    schema = "ticker string, Date date, `('Close', 'X')` double, `('Volume', '')` double, low double, `Adj Close` double"
    return _bars_out(price_files.normalize_frame(spark.read.schema(schema).parquet(path), "yfinance"))


@register("src_archive_scan", """WITH raw AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_linestatus AS st, l_extendedprice AS px
    FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT ticker, date, count(*) AS n, max(CASE WHEN st = 'O' THEN 1 ELSE 0 END) AS o FROM raw GROUP BY 1, 2)
SELECT upper(ticker) AS ticker, count(*) AS n_days, CAST(min(date) AS VARCHAR) AS first_date, CAST(sum(o) AS BIGINT) AS n_from_existing FROM n GROUP BY 1""")
def src_archive_scan(spark, sf):
    """Two archive folders scanned for all symbols, then merged under the stored bars."""
    li = inputs.table(spark, sf, "lineitem")
    part = inputs.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    px = F.col("l_extendedprice")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        "symbol", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), px.alias("open"), px.alias("high"), px.alias("low"),
        px.alias("close"), F.col("l_quantity").alias("volume"), F.lit(None).cast("double").alias("adj_close"), "l_linestatus")
    paths = [staging_path(spark, f"archive{i}") for i in (0, 1)]
    sinks.export(rows.filter("l_linestatus = 'F'").drop("l_linestatus"), paths[0])
    sinks.export(rows.filter("l_linestatus = 'O'").drop("l_linestatus"), paths[1])
    wanted = inputs.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    fresh = price_files.scan_archive(spark, paths[0], wanted).withColumn("origin", F.lit("fresh"))
    stored = price_files.scan_archive(spark, paths[1], wanted).withColumn("origin", F.lit("existing"))
    out = price_files.merge_bars(stored, fresh)
    return out.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").cast("string").alias("first_date"),
        F.count(F.when(F.col("origin") == "existing", 1)).alias("n_from_existing"))


@register("src_external_events", """SELECT count(*) AS n_events, count(DISTINCT p_brand) AS n_tickers, '1996-01-01' AS first_date,
  CAST(max(DATE '1996-01-01' + CAST(p_partkey % 1500 AS INTEGER)) AS VARCHAR) AS last_date FROM part WHERE p_partkey % 4 < 2""")
def src_external_events(spark, sf):
    k = F.col("p_partkey")
    d = F.date_add(F.lit("1996-01-01").cast("date"), (k % 1500).cast("int"))
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    sheet = inputs.table(spark, sf, "part").select(
        F.col("p_brand").alias("ticker"), F.col("p_name").alias("drug"), F.col("p_type").alias("disease"),
        F.when(k % 4 == 0, " Phase 2 ").when(k % 4 == 1, "phase3").when(k % 4 == 2, "Phase 1").otherwise("NDA").alias("stage"),
        F.when(k % 2 == 0, F.date_format(d, "M/d/yyyy")).otherwise(serial).alias("event_date"), F.lit("read, out").alias("event_desc"))
    path = staging_path(spark, "events")
    sinks.export(sheet, path)
    ev = documents.clinical_phase(documents.read_external_events(spark, path))
    return documents.event_manifest(ev).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@register("src_studies", """SELECT 'NCT' || o_orderkey AS nct_id, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE 'PHASE' || (o_orderkey % 5) END AS phase,
  c_mktsegment AS sponsor, CAST(CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate) ELSE CAST(o_orderdate AS TIMESTAMP) END AS VARCHAR)[1:10]
  AS start_date, CAST(o_custkey AS DOUBLE) AS enrollment, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS primary_met,
  1 + CAST(o_orderkey % 2 AS INTEGER) AS n_interventions FROM orders JOIN customer ON o_custkey = c_custkey""")
def src_studies(spark, sf):
    o = inputs.table(spark, sf, "orders")
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    date = lambda fmt: F.struct(F.date_format("o_orderdate", fmt).alias("date"))
    p = F.when(F.col("o_orderstatus") == "F", "<0.01").when(F.col("o_orderstatus") == "O", "0.2").otherwise("NA")
    item = lambda t, v: F.struct(F.lit(t).alias("type"), F.array(F.struct(v.alias("pValue"))).alias("analyses"))
    ps = F.struct(
        F.struct(F.concat(F.lit("NCT"), k.cast("string")).alias("nctId"), F.lit("t").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.lit("COMPLETED").alias("overallStatus"),
                 F.when(k % 3 == 0, date("yyyy-MM")).otherwise(date("yyyy-MM-dd")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.when(k % 5 != 0, F.array(F.concat(F.lit("PHASE"), (k % 5).cast("string")), F.lit("PHASE9"))).alias("phases"),
                 F.struct(F.col("o_custkey").cast("int").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.struct(F.col("c_mktsegment").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.when(k % 2 == 1, F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name"))))
                 .otherwise(F.array(F.struct(F.lit("a").alias("name")))).alias("interventions")).alias("armsInterventionsModule"),
    )
    rs = F.struct(F.struct(F.array(item("SECONDARY", F.lit("0.9")), item("PRIMARY", p), item("PRIMARY", F.lit("n/a"))).alias("outcomeMeasures"))
                  .alias("outcomeMeasuresModule"))
    path = staging_path(spark, "studies")
    o.join(c, o.o_custkey == c.c_custkey).select(ps.alias("protocolSection"), rs.alias("resultsSection")).write.json(path)
    return documents.read_studies(spark, path).select(
        "nct_id", "phase", "sponsor", F.col("start_date").cast("string"), F.col("enrollment").cast("double"), "primary_met",
        F.size("interventions").alias("n_interventions"))


@register("src_articles", """SELECT CAST(p_partkey AS VARCHAR) AS pmid, 'Effect of ' || p_name || ' & more' AS title, p_type || ' first. second ' || p_brand AS abstract,
  CASE WHEN p_partkey % 3 <> 2 THEN CAST(2000 + p_partkey % 20 AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '-03-07' ELSE '-01-01' END END AS publication_date,
  CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi FROM part""")
def src_articles(spark, sf):
    k = F.col("p_partkey").cast("string")
    year = (F.col("p_partkey") % 20 + 2000).cast("string")
    date = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<Year>"), year, F.lit("</Year><Month>Mar</Month><Day>7</Day>"))).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("<Year>"), year, F.lit("</Year><Month>Spring</Month>"))).otherwise("<Season>x</Season>")
    word = F.split("p_name", " ")
    ids = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<ArticleId IdType="doi">10.1/'), k, F.lit("</ArticleId>"))).otherwise("")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date,
        F.lit("</PubDate></JournalIssue></Journal><ArticleTitle>Effect of <i>"), word[0], F.lit("</i> "), word[1],
        F.lit(" &amp; more</ArticleTitle><Abstract><AbstractText>"), F.col("p_type"), F.lit(" first.</AbstractText><AbstractText>second "),
        F.col("p_brand"), F.lit('</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">'), k,
        F.lit("</ArticleId>"), ids, F.lit("</ArticleIdList></PubmedData></PubmedArticle>"))
    path = staging_path(spark, "articles")
    # One document per thousand articles: root tag, articles, closing tag, in that order inside each file.
    body = inputs.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 1000).alias("ticker"), F.lit(1).alias("o"), xml.alias("value"))
    ends = body.select("ticker").distinct().select("ticker", F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.lit("<PubmedArticleSet>").alias("value")),
        F.struct(F.lit(2).alias("o"), F.lit("</PubmedArticleSet>").alias("value")))).alias("e")).select("ticker", "e.*")
    _lines(body.unionByName(ends).repartition("ticker").sortWithinPartitions("ticker", "o"), path)
    return documents.read_articles(spark, path + "/*/*").withColumn("publication_date", F.col("publication_date").cast("string"))


@register("src_company_facts", """SELECT user_id AS cik, event_type AS tag, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'shares' END AS unit, count(*) AS n,
  round(sum(value), 2) + 0e0 AS total, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_filed FROM events GROUP BY 1, 2, 3""")
def src_company_facts(spark, sf):
    e = inputs.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    entry = F.struct(F.col("value").alias("val"), day.alias("end"), day.alias("filed"), F.lit("10-Q").alias("form"))
    unit = F.when(F.col("event_id") % 2 == 0, "USD").otherwise("shares").alias("unit")
    part = F.floor(F.col("event_id") / 10000).alias("part")  # documents of bounded size, several per issuer
    lists = e.groupBy("user_id", part, "event_type", unit).agg(F.collect_list(entry).alias("l"))
    tags = lists.groupBy("user_id", "part", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("unit", "l"))).alias("u"))
    docs = tags.groupBy(F.col("user_id").alias("cik"), "part").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(F.col("u").alias("units"))))).alias("t"))
    path = staging_path(spark, "facts")
    docs.select("cik", F.create_map(F.lit("us-gaap"), F.col("t")).alias("facts")).write.json(path)
    f = documents.read_company_facts(spark, path)
    return f.groupBy("cik", "tag", "unit").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("val"), 2).alias("total"),
                                               F.max("filed").cast("string").alias("last_filed"))


@register("src_ticker_cik", """SELECT upper(c_mktsegment) AS ticker, max(c_custkey) AS cik FROM customer GROUP BY 1""")
def src_ticker_cik(spark, sf):
    """Repeated tickers in one document: the last entry wins."""
    c = inputs.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max("c_custkey").alias("hi"), F.min("c_custkey").alias("lo"))
    ent = lambda v: F.struct(F.col(v).alias("cik_str"), F.lower("c_mktsegment").alias("ticker"), F.lit("t").alias("title"))
    pairs = F.array(F.struct(F.concat(F.lit("a"), F.col("lo").cast("string")).alias("k"), ent("lo").alias("v")),
                    F.struct(F.concat(F.lit("b"), F.col("hi").cast("string")).alias("k"), ent("hi").alias("v")))
    rows = c.select(F.explode(pairs).alias("p")).select("p.*")
    doc = rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("m"))
    path = staging_path(spark, "cik")
    doc.select(F.to_json("m").alias("value")).write.text(path)
    return documents.read_ticker_cik(spark, path)


@register("src_base_rates", """WITH m AS (SELECT p_type, p_brand, count(*) AS n, avg(p_size) AS s FROM part GROUP BY 1, 2)
SELECT p_type AS phase, p_brand AS indication_group, round(s / 100, 6) + 0e0 AS success_rate, CAST(n AS INTEGER) AS n_programs FROM m""")
def src_base_rates(spark, sf):
    m = inputs.table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("s"))
    null = F.lit(None).cast("string")
    out = m.select(F.lit("x").alias("source"), F.col("p_type").alias("phase"), F.col("p_brand").alias("indication_group"), null.alias("modality"),
                   F.lit(False).alias("biomarker_enriched"), (F.col("s") / 100).alias("success_rate"), F.col("n").alias("n_programs"),
                   F.lit("2000-2015").alias("effective_year_range"), null.alias("notes"))
    path = staging_path(spark, "rates")
    sinks.export(out, path)
    return documents.read_base_rates(spark, path).select("phase", "indication_group", rnd("success_rate").alias("success_rate"), "n_programs")


@register("src_delisted", """SELECT c_custkey AS id, c_name AS name FROM customer""")
def src_delisted(spark, sf):
    path = staging_path(spark, "delisted")
    inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.json(path)
    return documents.read_delisted(spark, path, "id bigint, name string", "id")


@register("src_lookup", f"""WITH {EVTS}, t AS (SELECT 'Brand#' || (n_nationkey + 1) AS ticker, CASE n_regionkey WHEN 0 THEN 'large_pharma' ELSE 'mid_cap' END AS tier FROM nation)
SELECT tier, count(*) AS n FROM evts JOIN t USING (ticker) GROUP BY 1""")
def src_lookup(spark, sf):
    n = inputs.table(spark, sf, "nation").select(
        F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("ticker"),
        F.when(F.col("n_regionkey") == 0, "large_pharma").otherwise("mid_cap").alias("tier"))
    path = staging_path(spark, "tiers")
    n.write.json(path)
    tiers = documents.read_lookup(spark, path, "ticker string, tier string")
    return inputs.catalysts(spark, sf).join(tiers, "ticker").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


_PROVIDER_BARS = """b AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_linestatus AS provider, avg(l_extendedprice) AS px,
    sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def _as_bars(spark, sf):
    b = inputs.bars(spark, sf, by_provider=True)
    px = F.col("adj_close")
    return b.select("ticker", "date", px.alias("open"), "high", "low", px.alias("close"), "adj_close", "volume", "provider")


@register("snk_bar_cache", f"WITH {_PROVIDER_BARS} SELECT provider, ticker, count(*) AS n, {r('avg(px)', 4)} AS mean_px FROM b GROUP BY 1, 2")
def snk_bar_cache(spark, sf):
    path = staging_path(spark, "cache")
    sinks.write_bar_cache(_as_bars(spark, sf), path)
    cols = "date date, open double, high double, low double, close double, adj_close double, volume double, provider string, ticker string"
    return spark.read.schema(cols).parquet(path).groupBy("provider", "ticker").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("adj_close"), 4).alias("mean_px"))


@register("snk_bars_ranged", f"WITH {_PROVIDER_BARS} SELECT ticker, count(*) AS n FROM b WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-09-30' GROUP BY 1")
def snk_bars_ranged(spark, sf):
    """Year folders prune partitions; the range layout prunes row groups."""
    path = staging_path(spark, "bars")
    sinks.write_bars(_as_bars(spark, sf), path)
    stored = spark.read.parquet(path).filter("year = 1997")
    return price_files.in_range(stored, "1997-03-01", "1997-09-30").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@register("snk_incremental_ingest", f"WITH {_PROVIDER_BARS} SELECT provider, count(*) AS n, {r('sum(v)', 2)} AS volume FROM b GROUP BY 1")
def snk_incremental_ingest(spark, sf):
    """Two landings with an overlap: the second adds only the keys the first lacked."""
    from eventide.streaming.ingest import ingest_landed

    landed, target, ck = (staging_path(spark, n) for n in ("landed", "target", "ingest"))
    rows = _as_bars(spark, sf)
    rows.filter("provider = 'F'").write.parquet(landed)
    ingest_landed(spark, landed, target, ck).awaitTermination()
    rows.write.mode("append").parquet(landed)
    ingest_landed(spark, landed, target, ck).awaitTermination()
    return spark.read.parquet(target).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("volume"), 2).alias("volume"))


@register("snk_refresh_snapshots", """SELECT event_type, 2 * count(*) AS n_snapshots, count(*) AS n_current FROM events GROUP BY 1""")
def snk_refresh_snapshots(spark, sf):
    """Snapshots are only ever added; the current table is replaced as a whole."""
    e = inputs.table(spark, sf, "events").select("event_id", "event_type", "value")
    snaps, current = staging_path(spark, "snaps"), staging_path(spark, "current")
    for _ in range(2):
        sinks.append_snapshots(e, snaps)
        sinks.refresh(e, current)
    s = spark.read.parquet(snaps).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_snapshots"))
    c = spark.read.parquet(current).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_current"))
    return s.join(c, "event_type")


@register("snk_freeze", """SELECT 'orders' AS name, 'copied' AS status, CAST(count(*) AS DOUBLE) AS n_rows FROM orders
UNION ALL SELECT 'customer', 'copied', CAST(count(*) AS DOUBLE) FROM customer UNION ALL SELECT 'ledger', 'missing', NULL""")
def snk_freeze(spark, sf):
    tables = {"orders": inputs.table(spark, sf, "orders"), "customer": inputs.table(spark, sf, "customer"), "ledger": None}
    m = sinks.freeze(tables, staging_path(spark, "frozen"), "baseline_1")
    return m.select("name", "status", F.col("n_rows").cast("double"))


@register("snk_bundle", """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT 'companies' AS name, count(DISTINCT c_nationkey) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'programs', count(*) FROM orders UNION ALL SELECT 'program_t0', count(*) FROM orders
UNION ALL SELECT 'clinical_trials', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'trial_outcomes', count(*) FROM orders
UNION ALL SELECT 'source_records', count(DISTINCT l_partkey) FROM s UNION ALL SELECT 'publications', count(DISTINCT l_partkey) FROM s
UNION ALL SELECT 'publication_program_links', count(*) FROM s UNION ALL SELECT 'animal_studies', count(*) FROM lineitem
UNION ALL SELECT 'animal_study_features', count(*) FROM lineitem UNION ALL SELECT 'program_preclinical_features', count(*) FROM orders
UNION ALL SELECT 'program_financial_events', count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def snk_bundle(spark, sf):
    ev = inputs.catalysts(spark, sf)
    st = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("program_id"), F.col("l_partkey").alias("pmid"), F.col("l_returnflag").alias("species"),
        F.col("l_discount").alias("effect_size"))
    k = F.col("catalyst_id")
    b = ev.select(k.alias("program_id"), "ticker", F.col("ticker").alias("company_name"), "drug_name", "indication",
                  F.col("announcement_date").alias("t0_date"), F.when(k % 2 == 0, F.concat(F.lit("NCT"), k.cast("string"))).alias("nct_id"),
                  "clinical_success", F.when(F.col("clinical_success").isNotNull(), F.col("announcement_date")).alias("event_date"))
    tables = sinks.bundle_tables(b, st)
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("snk_exports", f"""WITH {EVTS} SELECT ticker, count(*) AS n, {r('sum(amount)', 2)} AS amount FROM evts GROUP BY 1""")
def snk_exports(spark, sf):
    """A result frame exported as CSV and read back with its schema."""
    path = staging_path(spark, "export")
    sinks.export(inputs.catalysts(spark, sf).select("catalyst_id", "ticker", "amount"), path)
    back = spark.read.schema("catalyst_id bigint, ticker string, amount double").csv(path, header=True)
    return back.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("amount"), 2).alias("amount"))
