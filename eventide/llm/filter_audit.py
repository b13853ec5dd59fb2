"""How document filters interact: what each removes, alone and after the others, in every order.

Method: one pass over the texts writes a narrow row per document (id, part, mask of failed text filters, two 64-bit hashes).
A counting Bloom sketch of the hashes is added up on the executors, segment by segment; a text that meets a cell with a count of
one is surely unique. Only the other texts are shuffled, whole, to find the smallest id of each text exactly. Masks of failed
filters are then counted per part, and every figure of every order is a sum of those counts.

The sketch has 16 cells a document up to CELLS (64 MiB as a bitmap, the only thing that is broadcast). A fuller sketch lets
more unique texts through to the exact step; it never changes a result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
#: Bits of the mask, in the order of FILTERS.
A, B, C, D, E = (1 << i for i in range(5))

CELLS = 1 << 29
_CELLS_A_DOCUMENT, _PROBES, _SEGMENTS = 16, 4, 512
_SLICE = 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")
_UPPER = bytes(range(0x41, 0x5B))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split in slices, so that only its distinct words are held."""
    n, seen, start = 0, set(), 0
    while start < len(raw):
        cut = _WHITE.search(raw, start + _SLICE)
        end = cut.start() if cut else len(raw)
        words = raw[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def text_mask(raw: bytes) -> int:
    """The filters A to D that a text fails."""
    n, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _CONTINUATION))
    return (
        A * (n < MIN_WORDS)
        + B * (100 * distinct < MIN_DISTINCT_PERCENT * n)
        + C * (100 * upper > MAX_UPPER_PERCENT * points)
        + D * (_SYMBOL.search(raw) is not None)
    )


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and two independent 64-bit hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), *more)


def _facts(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros(batch.num_rows, np.int32)
            for first, end, data, offsets in tk.chunks(batch.column(1)):
                for i in range(end - first):
                    masks[first + i] = text_mask(data[offsets[i] : offsets[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(masks), batch.column(2), batch.column(3)], ["doc_id", "part", "mask", "k1", "k2"]
            )

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(_keyed(docs, part).mapInArrow(read, f"doc_id {kind}, part string, mask int, k1 long, k2 long"), "filter_facts")


def _probes(batch: pa.RecordBatch, cells: int) -> np.ndarray:
    """rows x _PROBES different cells of each text (the step is odd, the number of cells a power of two)."""
    k1, k2 = (batch.column(batch.schema.get_field_index(k)).to_numpy().view(np.uint64) for k in ("k1", "k2"))
    return (k1[:, None] + np.arange(_PROBES, dtype=np.uint64) * (k2 | np.uint64(1))[:, None]) & np.uint64(cells - 1)


def repeat_bitmap(facts: DataFrame, cells: int) -> np.ndarray:
    """Bitmap, in bytes, of the cells of the merged counting sketch that two or more rows with an id met.

    A task sends, per segment, the cells that it met and whether it met them more than once; a segment's owner reads these rows
    as they come and keeps one saturating counter per cell.
    """
    size = cells // _SEGMENTS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, times = np.unique(_probes(batch, cells).astype(np.int64), return_counts=True)
            cuts = np.searchsorted(met, np.arange(_SEGMENTS + 1) * size)
            packed = ((met % size) * 2 + (times > 1)).astype(np.uint32)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([packed[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary())], ["segment", "cells"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, counts = -1, np.zeros(size, np.uint8)

        def done() -> pa.RecordBatch:
            bits = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for s, sent in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != segment:
                    if segment >= 0:
                        yield done()
                    segment, counts = s, np.zeros(size, np.uint8)
                cell = np.frombuffer(sent.as_buffer(), np.uint32)
                counts[cell >> 1] = np.minimum(counts[cell >> 1] + 1 + (cell & 1), 2)
        if segment >= 0:
            yield done()

    parts = facts.filter("doc_id is not null").select("k1", "k2").mapInArrow(sketch, "segment int, cells binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary").toArrow()
    out = np.zeros(cells // 8, np.uint8)
    for s, bits in zip(merged["segment"].to_pylist(), merged["bits"], strict=True):
        out[s * size // 8 : (s + 1) * size // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _sieve(rows: DataFrame, bitmap: np.ndarray, possible: bool) -> DataFrame:
    """The rows whose text may occur in another row, or those whose text surely occurs once."""
    cells = 8 * len(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probes(batch, cells)
            met_twice = bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(met_twice.all(axis=1) == possible))

    return rows.mapInArrow(keep, rows.schema)


def _flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask with all five filters, and n rows that have them."""
    facts = _facts(docs)
    known = facts.filter("doc_id is not null")
    cells = min(CELLS, max(1 << 16, 1 << math.ceil(math.log2(_CELLS_A_DOCUMENT * max(facts.count(), 1)))))
    bitmap = repeat_bitmap(facts, cells)
    ids = ["doc_id", "k1", "k2"]
    # the smallest id of each text that may repeat; rows of a text with another id fail filter E
    texts = _sieve(_keyed(docs.filter("doc_id is not null")), bitmap, True).groupBy("text", "k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    firsts = texts.select(*ids, F.lit(True).alias("is_first"))
    repeats = _sieve(known, bitmap, True).groupBy(*ids, "part", "mask").agg(F.count("*").alias("n"))
    fails = F.when(F.col("is_first").isNull(), E).otherwise(0)
    repeats = repeats.join(firsts, ids, "left").select("doc_id", "part", (F.col("mask") + fails).alias("mask"), "n")
    clear = _sieve(known, bitmap, False).select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    nameless = facts.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    nameless = nameless.select(F.lit(None).cast(facts.schema["doc_id"].dataType).alias("doc_id"), "part", "mask", "n")
    return clear.union(repeats).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).union(nameless)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic rows per part and mask of failed filters."""
    is_one = {name: F.max(F.when(F.col(column) == 1, 1).otherwise(0)).alias(name) for name, column in (("good", "quality"), ("toxic", "toxic"))}
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(*is_one.values())
    rows = _flagged(docs)
    named = rows.filter("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    nameless = rows.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return named.union(nameless).groupBy("part", "mask").agg(*sums, F.sum("n").alias("n"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included; columns as in the contract of the query.

    A null source is the part ''; a null text is empty (it fails filter A). A row without an id is nobody's copy and nobody is
    its copy; rows that share id and text are not copies of each other. A label counts if any row of labels for the id holds it. An
    empty table has no part, so no row. Other columns are not read.
    """
    counts = mask_counts(docs, labels)
    bits = [1 << i for i in range(5)]
    before = [(sum(set_), f) for f in bits for r in range(5) for set_ in itertools.combinations([b for b in bits if b != f], r)]
    case = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p, f in before])).alias("case")
    fails, gone = F.col("mask").bitwiseAND(F.col("f")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0

    def total(name: str, column: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(column)).otherwise(0)).alias(name)

    figures = counts.select("*", case).select("*", "case.p", "case.f").groupBy("part", "p", "f").agg(
        total("kept", "n", ~fails & ~gone), total("removed", "n", fails & ~gone), total("redundant", "n", fails & gone),
        total("unique_fails", "n", F.col("mask") == F.col("f")), total("good_lost", "good", fails & ~gone), total("toxic_lost", "toxic", fails & ~gone),
    )
    # so many of the 120 orders put exactly the filters of p before f
    orders = F.factorial(F.bit_count("p")) * F.factorial(4 - F.bit_count("p"))
    figures = figures.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "f")))
    steps = [
        ("".join(o), i + 1, sum(1 << FILTERS.index(x) for x in o[:i]), 1 << FILTERS.index(o[i])) for o in itertools.permutations(FILTERS) for i in range(5)
    ]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, p int, f int")
    return figures.join(F.broadcast(table), ["p", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
