"""A corpus pipeline in stages, each one operator of `eventide.llm` over all that the stage before kept.

Every stage judges rows, not ids: a row without doc_id, or with one that other rows have too, stays or goes by its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import decontamination, ngram_join, packing, quality, toxicity
from eventide.llm.id_filter import id_bitmap, wanted
from eventide.llm.queries import _tokenizer
from eventide.llm.tables import cut_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage in a session of small Arrow batches. They stay small, since what a stage returns is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        cut_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled documents of the stage's input, does not reject."""
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@lean
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


@lean
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its rows with the smallest id (rows without one come last) the first by
    a hash of all columns. Groups are those of texts, so equal texts are one, whatever their ids. Rows whose shingle set is
    empty are in no group and stay.

    Texts are told apart by 128 bits of hashes. Decisions are made on narrow rows; a bitmap of fixed size lets the rows of texts
    that nothing was decided about pass where they are, so that only the others are shuffled whole.
    """
    columns = docs.columns
    full = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    keys = {"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit("second"), "text")}
    place = F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*columns).alias("d1"), F.xxhash64(F.lit("second"), *columns).alias("d2")
    ).alias("_place")
    rows = docs.filter(full).withColumns(keys).select("*", place)
    # equal rows are counted first: of several one has to be taken, which the rows themselves cannot tell
    equal = rows.groupBy("_k1", "_k2", "_place").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("_place").alias("place"), "copies")).alias("least")
    texts = written(equal.groupBy("_k1", "_k2").agg(least, F.sum("copies").alias("rows")).select("_k1", "_k2", "least.place", "least.copies", "rows"), "texts")
    found = ngram_join.similar_components(_named(rows, texts).select(F.col("_node").alias("doc_id"), "text"))
    groups = found.groupBy(F.col("doc_id").alias("_node")).agg(F.min("component_id").alias("component"))
    grouped = written(_named(texts, texts).join(groups, "_node"), "groups")
    first = grouped.groupBy("component").agg(F.min(F.struct("place", "_k1", "_k2")).alias("first")).select("first._k1", "first._k2", F.lit(True).alias("stays"))
    decided = grouped.join(first, ["_k1", "_k2"], "left").filter("stays is null or rows > 1")
    decided = written(decided.select("_k1", "_k2", "stays", "copies", F.col("place.d1").alias("d1"), F.col("place.d2").alias("d2")), "decided")
    touched = id_bitmap(decided, "_k1")
    # one join of the touched rows with the decisions: texts that nothing was decided about stay, of the others the first row
    judged = _with_bitmap(rows, touched, True).join(decided, ["_k1", "_k2"], "left")
    judged = judged.filter("copies is null or (stays and _place.d1 = d1 and _place.d2 = d2)")
    several = judged.filter("copies > 1").dropDuplicates(["_k1", "_k2"])
    passed = _with_bitmap(rows, touched, False)
    parts = (passed, judged.filter("copies is null or copies = 1"), several)
    return docs.filter(~full).unionByName(reduce(DataFrame.unionByName, [part.select(*columns) for part in parts]))


def _named(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with `_node`, a 64-bit name of their text: its first hash, or its second one where two texts share the first (none is
    expected below 10^9 texts, and then nothing is joined)."""
    clash = texts.groupBy("_k1").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k1", F.lit(True).alias("_clash"))
    if clash.isEmpty():
        return rows.withColumn("_node", F.col("_k1"))
    return rows.join(clash, "_k1", "left").withColumn("_node", F.when(F.col("_clash"), F.col("_k2")).otherwise(F.col("_k1"))).drop("_clash")


def _with_bitmap(rows: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose text key may be in the bitmap, or those whose key surely is not."""
    at = rows.columns.index("_k1")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = wanted(bitmap, batch.column(at).to_numpy()) == inside
            # kept rows leave in slices, so that long texts are copied a few at a time
            for first in range(0, batch.num_rows, 256):
                yield batch.slice(first, 256).filter(pa.array(marks[first : first + 256]))

    return rows.mapInArrow(keep, rows.schema)


@lean
def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left."""
    return packing.pack(docs, _tokenizer())


STAGES = [
    ("toxicity", not_toxic),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", not_in_benchmark),
    ("packing", packed),
]

#: The classifiers, the edit matching and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
