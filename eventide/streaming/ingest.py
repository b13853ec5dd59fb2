"""Insert-or-ignore of newly landed bars as an incremental job over the same batch operator.

The store is laid out by provider and year. A batch is anti-joined with the stored keys of its own partitions and days only, so
the cost of a landing follows the landing, not the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import schemas
from eventide.operators.registry import dedupe_first

KEYS = ("ticker", "date", "provider")
LAYOUT = ("provider", "bar_year")
_SCHEMA = f"{schemas.BARS}, bar_year int"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored bars; the store is made, without rows, if it is not there."""
    spark.createDataFrame([], _SCHEMA).write.partitionBy(*LAYOUT).mode("ignore").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path)


def touched_partitions(batch: DataFrame) -> list[tuple]:
    """(provider, year, first day, last day) of a batch: one row per provider and calendar year."""
    rows = batch.groupBy("provider", F.year("date").alias("y")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return sorted((tuple(r) for r in rows.filter("provider is not null and y is not null").collect()), key=str)


def stored_keys(store: DataFrame, touched: list[tuple]) -> DataFrame:
    """Keys of the store that a batch may repeat: its partitions are listed, and files outside its days are skipped by their
    statistics."""
    if not touched:
        return store.select(*KEYS).limit(0)

    def inside(provider: str, year: int, lo, hi) -> Column:
        return (F.col("provider") == provider) & (F.col("bar_year") == year) & F.col("date").between(F.lit(lo), F.lit(hi))

    days = F.col("date").between(F.lit(min(t[2] for t in touched)), F.lit(max(t[3] for t in touched)))
    return store.filter(reduce(lambda a, b: a | b, [inside(*t) for t in touched]) & days).select(*KEYS)


def append_new_bars(batch: DataFrame, path: str) -> None:
    """Append the batch's bars whose (ticker, date, provider) is not stored; replays add nothing."""
    store = open_store(batch.sparkSession, path)
    fresh = dedupe_first(batch, list(KEYS), ["open", "high", "low", "close", "adj_close", "volume"])
    fresh = fresh.join(stored_keys(store, touched_partitions(batch)), list(KEYS), "left_anti")
    out = fresh.select(*[f.split()[0] for f in schemas.BARS.split(", ")], F.year("date").alias("bar_year"))
    # rows of a partition lie together and in order, so that a later landing skips files by their statistics; large ones are split
    out.hint("rebalance", *LAYOUT).sortWithinPartitions(*LAYOUT, "date", "ticker").write.partitionBy(*LAYOUT).mode("append").parquet(path)


def ingest_landed(spark: SparkSession, landed: str, target: str, checkpoint: str):
    """Process everything landed so far, once per file, then stop."""
    stream = spark.readStream.schema(schemas.BARS).parquet(landed)
    return (
        stream.writeStream.foreachBatch(lambda df, _id: append_new_bars(df, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
