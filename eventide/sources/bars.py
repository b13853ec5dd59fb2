"""Landed price files of five vendors, archive scans and the bar cache."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import schemas
from eventide.operators.registry import dedupe_first

VALUE_COLS = ("open", "high", "low", "close", "adj_close", "volume")
# Vendor spellings of standard column names.
RENAMES = {"adj close": "adj_close", "adjclose": "adj_close", "vol": "volume", "stock splits": "split", "dividends": "dividend"}
FILE_NAME = r"([^/]+)\.[A-Za-z]+$"


def _ticker(path: Column, pattern: str) -> Column:
    return F.upper(F.regexp_extract(path, pattern, 1))


def _cells(line: Column) -> Column:
    """The cells of a CSV line; a quoted cell may hold commas, and doubled quotes stand for one."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('(\\s*"(?:[^"]|"")*"\\s*|[^,]*),'), 1)
    return F.transform(raw, lambda c: F.replace(F.regexp_replace(c, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"')))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields): rows of headered CSV files whose columns may differ from file to file.

    Each file's own first line names its columns (trimmed, lower-cased). Files whose first line is
    markup or lacks a `date` column yield nothing. The header table holds one row per file.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("at"),
    ).filter("line <> ''")
    head = lines.groupBy("file").agg(F.min_by("line", "at").alias("header"))
    names = F.transform(_cells(F.lower("header")), lambda c: F.trim(c))
    good = head.select("file", "header", names.alias("names")).filter(
        ~F.col("header").startswith("<") & F.array_contains("names", "date"))
    rows = lines.join(good, "file").filter(F.col("line") != F.col("header"))
    values = _cells(F.col("line"))
    padded = F.transform(F.col("names"), lambda c, i: F.get(values, i))
    return rows.select("file", F.map_from_arrays("names", padded).alias("fields"))


def _from_fields(rows: DataFrame, provider: str, pattern: str) -> DataFrame:
    field = lambda n: F.coalesce(*[
        F.col("fields").getItem(k) for k in (n, *[a for a, b in RENAMES.items() if b == n])])
    num = lambda n: F.trim(field(n)).try_cast("double")
    has_adj = F.array_contains(F.map_keys("fields"), "adj_close") | F.exists(
        F.map_keys("fields"), lambda k: k.isin("adj close", "adjclose"))
    return rows.select(
        _ticker(F.col("file"), pattern).alias("ticker"),
        F.try_to_timestamp(F.substring(F.trim(field("date")), 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close")],
        F.when(has_adj, num("adj_close")).otherwise(num("close")).alias("adj_close"),
        num("volume").alias("volume"),
        F.lit(provider).alias("provider"),
    ).filter("date is not null")


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive on both ends."""
    if start:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    return bars.filter(F.col("date") <= F.lit(end).cast("date")) if end else bars


def read_local_csv(spark: SparkSession, path: str, pattern: str = FILE_NAME, start: str | None = None,
                   end: str | None = None) -> DataFrame:
    return in_range(_from_fields(csv_rows(spark, path), "local_csv", pattern), start, end)


def read_stooq(spark: SparkSession, path: str, pattern: str = FILE_NAME) -> DataFrame:
    return _from_fields(csv_rows(spark, path), "stooq", pattern)


def read_polygon(spark: SparkSession, path: str, pattern: str = FILE_NAME) -> DataFrame:
    """One payload per ticker; error payloads and payloads without results are empty. Epoch milliseconds
    are UTC whatever the session time zone."""
    docs = spark.read.schema(schemas.POLYGON).json(path, multiLine=True).select(
        "status", "results", _ticker(F.col("_metadata.file_path"), pattern).alias("ticker"))
    bars = docs.filter(F.coalesce("status", F.lit("")) != "ERROR").select("ticker", F.explode("results").alias("b"))
    return bars.select(
        "ticker", F.date_from_unix_date(F.floor(F.col("b.t") / 86400000).cast("int")).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"),
        F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.c").alias("adj_close"), F.col("b.v").alias("volume"),
        F.lit("polygon").alias("provider"))


def read_eodhd(spark: SparkSession, path: str, pattern: str = FILE_NAME) -> DataFrame:
    """A JSON array per ticker. The adjusted close falls back to the close only where its key is absent,
    so objects are read as maps. A payload holds one ticker's daily bars, which bounds its size."""
    docs = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<map<string,string>>").alias("a"), _ticker(F.col("_metadata.file_path"), pattern).alias("ticker"))
    b = F.col("b")
    num = lambda n: b.getItem(n).try_cast("double")
    adj = F.when(F.map_contains_key(b, "adjusted_close"), num("adjusted_close")).otherwise(num("close"))
    return docs.select("ticker", F.explode("a").alias("b")).select(
        "ticker", F.substring(b.getItem("date"), 1, 10).cast("date").alias("date"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close")], adj.alias("adj_close"), num("volume").alias("volume"),
        F.lit("eodhd").alias("provider"))


def normalize_frame(df: DataFrame, provider: str) -> DataFrame:
    """Frames landed with vendor headers: tuple names keep their first element, names are lower-cased and
    standardised, and a missing adjusted close is the close (also the already adjusted variant)."""
    clean = {}
    for c in df.columns:
        m = re.match(r"\('([^']*)'", c)
        name = (m.group(1) if m else c).strip().lower()
        clean[c] = RENAMES.get(name, name)
    out = df.withColumnsRenamed(clean)
    if "adj_close" not in out.columns:
        out = out.withColumn("adj_close", F.col("close"))
    missing = {c: F.lit(None).cast("double") for c in VALUE_COLS if c not in out.columns}
    return out.withColumns(missing).select(
        "ticker", F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in VALUE_COLS],
        F.lit(provider).alias("provider"))


def scan_archive(spark: SparkSession, paths: Sequence[str] | str, wanted: DataFrame) -> DataFrame:
    """Bars of the wanted symbols over many archive files, the first row per (symbol, date) in file and
    line order. `wanted`: ticker."""
    raw = spark.read.schema(schemas.ARCHIVE).csv(paths, header=True)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("a"),
                  F.monotonically_increasing_id().alias("b"))
    named = raw.select(
        F.upper("symbol").alias("ticker"), F.substring("date", 1, 10).cast("date").alias("date"),
        *[c for c in VALUE_COLS if c != "adj_close"], F.coalesce("adj_close", "close").alias("adj_close"), at.alias("_at"))
    kept = named.join(wanted.select(F.upper("ticker").alias("ticker")), "ticker", "left_semi")
    return dedupe_first(kept, ["ticker", "date"], ["_at"]).drop("_at")


def merge_bars(existing: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """One row per (ticker, date); existing rows win unless forced."""
    first, second = (fresh, existing) if force else (existing, fresh)
    cols = existing.columns
    stacked = first.select(*cols, F.lit(0).alias("_p")).unionByName(second.select(*cols, F.lit(1).alias("_p")))
    return dedupe_first(stacked, ["ticker", "date"], ["_p"]).select(*cols)
