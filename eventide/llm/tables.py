"""Small helpers of the queries and operators: input tables, intermediate tables, learning rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import staging_path

#: Longer texts are scored but not learned from, so that a sample of rows has a bounded size.
SAMPLE_CHARS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: several readers, one computation, and no lineage to repeat
    when an executor is lost."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_batches(spark: SparkSession, size: str = "4m") -> str:
    """From now on the session hands rows to Python in Arrow batches of about `size`, not of Spark's 64 MB: a batch is held by the
    executor and by its worker, once for every task. Returns the size before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """`cut_batches` for what is computed inside; the session's own size comes back at the end."""
    before = cut_batches(spark)
    try:
        yield
    finally:
        cut_batches(spark, before)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; labels of fold 0 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def rows_with(docs: DataFrame, keep: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """The rows of docs, with their columns, for whose text keep, which gives (first row, marks) by chunks, is true; each row is judged by itself."""
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, marks in keep(batch.column(at)):
                yield batch.slice(first, len(marks)).filter(pa.array(marks, pa.bool_()))

    return docs.mapInArrow(read, docs.schema)
