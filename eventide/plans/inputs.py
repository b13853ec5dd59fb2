"""Domain inputs derived from the supplied star-schema tables (see FIXTURES.md, part B).

Every input covers the whole tables: each order is an event, each line item a trade print.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.cutoffs import trading_cutoffs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_prints(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Line items reduced to (ticker, date, flag, provider) sums, the shared base of bars and benchmarks:
    both branches read the same exchange, so the large table is scanned once. The explicit null
    filter keeps the branches alike whatever filters their later joins imply."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("date")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("ticker"))
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .filter(F.col("ticker").isNotNull() & F.col("date").isNotNull())
        .groupBy("ticker", "date", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("provider"))
        .agg(
            F.sum("l_extendedprice").alias("px"),
            F.count("l_extendedprice").alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.min("l_extendedprice").alias("lo"),
            F.max("l_extendedprice").alias("hi"),
        )
    )


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand", by_provider: bool = False) -> DataFrame:
    """Daily bars: one row per (ticker, date), or per (ticker, date, provider)."""
    keys = ["ticker", "date"] + (["provider"] if by_provider else [])
    return daily_prints(spark, sf_dir, key).groupBy(*keys).agg(
        (F.sum("px") / F.sum("n")).alias("adj_close"),
        F.sum("qty").alias("volume"),
        F.min("lo").alias("low"),
        F.max("hi").alias("high"),
    )


def benchmarks(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Long (benchmark, date, adj_close): SPY over all line items, XBI over returned ones."""
    returned = F.col("flag") == "A"
    daily = (
        daily_prints(spark, sf_dir, key)
        .groupBy("date")
        .agg(
            (F.sum("px") / F.sum("n")).alias("spy"),
            F.try_divide(F.sum(F.when(returned, F.col("px"))), F.sum(F.when(returned, F.col("n")))).alias("xbi"),
        )
    )
    pair = F.array(
        F.struct(F.lit("SPY").alias("benchmark"), F.col("spy").alias("adj_close")),
        F.struct(F.lit("XBI").alias("benchmark"), F.col("xbi").alias("adj_close")),
    )
    return daily.select("date", F.explode(pair).alias("b")).select("date", "b.*").where(
        "adj_close is not null"
    )


def catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order: the customer's nation is the issuer, its segment the drug."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    timing = F.element_at(
        F.array(F.lit("BMO"), F.lit("AMC"), F.lit("DURING"), F.lit("UNKNOWN")), (key % 4 + 1).cast("int")
    )
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("catalyst_id"),
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("announcement_date"),
        F.when(status == "F", 1).when(status == "O", 0).cast("int").alias("clinical_success"),
        F.col("c_mktsegment").alias("drug_name"),
        F.col("o_orderpriority").alias("indication"),
        timing.alias("timing"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("acctbal"),
    )


def catalysts_with_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the inferred cutoffs, an entry cutoff that is missing for a third of the events, and the
    observation date of one feature family (days around the cutoff, sometimes missing)."""
    key = F.col("catalyst_id")
    ev = trading_cutoffs(catalysts(spark, sf_dir), "announcement_date", "timing")
    ev = ev.withColumn("entry_cutoff_date", F.when(key % 3 != 0, F.date_sub("trading_cutoff_date", 1)))
    base = F.coalesce("entry_cutoff_date", "trading_cutoff_date", "announcement_date")
    return ev.withColumn(
        "observed_at",
        F.when(key % 11 != 0, F.date_add(base, (key % 7 - 3).cast("int"))),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions, one per order, with realised outcome and exposure."""
    ev = catalysts(spark, sf_dir)
    bal = F.col("acctbal")
    p_fail = (bal + 1000.0) / 11000.0
    wobble = ((F.col("catalyst_id") * 7919) % 2001 - 1000) / F.lit(20000.0)
    dep = (
        F.when(bal <= 0, F.lit(None).cast("double"))
        .when(bal >= 5000, F.lit(0.15))
        .when(bal >= 500, F.lit(0.45))
        .otherwise(F.lit(0.85))
    )
    return ev.select(
        "catalyst_id",
        "ticker",
        "drug_name",
        "indication",
        "announcement_date",
        F.year("announcement_date").alias("test_year"),
        "clinical_success",
        p_fail.alias("p_failure"),
        dep.alias("company_dependency"),
        ((F.lit(1.0) - p_fail) * 0.10 + p_fail * -0.15 + wobble).alias("expected_car"),
        (F.col("amount") / 500000.0 - 0.5).alias("realized_car"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed facts per issuer: `filed` is the event day, `end` lies up to five days before it."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cik"),
        F.col("event_type").alias("tag"),
        F.to_date("ts").alias("filed"),
        F.date_sub(F.to_date("ts"), (F.col("event_id") % 6).cast("int")).alias("end"),
        F.col("event_id").alias("pos"),
        F.col("value").alias("val"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study records: one per line item, the order is its program. Flags are three-valued."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    n = F.col("l_linenumber")
    flag = F.when(n % 5 != 0, (n % 2).cast("int"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("program_id"),
        F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("study_id"),
        F.col("l_discount").alias("effect_size"),
        F.col("l_tax").alias("p_value"),
        F.col("l_returnflag").alias("species"),
        F.col("p_type").alias("disease_model"),
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("pending").alias("verification_status"),
        flag.alias("randomized"),
        F.when(n % 3 != 0, (n % 2).cast("int")).alias("blinded"),
        F.when(n == 7, F.lit(1)).when(n == 6, F.lit(0)).cast("int").alias("survival_benefit"),
        F.col("p_size").alias("face_validity"),
        F.to_date("l_shipdate").alias("publication_date"),
    )


PHRASES = (
    "Overall survival at two years",
    "Progression-free survival (PFS) by review",
    "Objective response rate",
    "Safety and tolerability; MTD",
    "Change in tumour size",
    "Adverse event count and OS",
    "Complete response, ORR",
    "cosy closs of response ratex",
)
DESIGNS = (
    ("PHASE2", "RANDOMIZED", "DOUBLE", '["drug a","drug b"]'),
    ("phase3", "Randomized", "NONE", '["drug a plus drug b"]'),
    ("PHASE1/PHASE2", "NON_RANDOMIZED", "Open Label", '["drug a"]'),
    (None, None, None, None),
    ("PHASE9", "NA", "QUADRUPLE", "not json"),
)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial record per order, design and outcome text picked by key."""
    key = F.col("o_orderkey")
    designs = F.array(
        *[
            F.struct(*[F.lit(v).cast("string").alias(n) for n, v in
                       zip(("phase", "allocation", "masking", "intervention"), d)])
            for d in DESIGNS
        ]
    )
    texts = F.array(*[F.lit(p) for p in PHRASES])
    return table(spark, sf_dir, "orders").select(
        key.alias("catalyst_id"),
        F.element_at(designs, (key % 5 + 1).cast("int")).alias("d"),
        F.element_at(texts, (key % 8 + 1).cast("int")).alias("outcome_text"),
        F.when(key % 10 != 0, F.floor(F.col("o_totalprice") / 1000.0).cast("int")).alias("enrollment"),
    ).select("catalyst_id", "d.*", "outcome_text", "enrollment")
