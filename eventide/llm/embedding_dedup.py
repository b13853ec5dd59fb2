"""Near-duplicate embeddings by cosine.

Method: random-hyperplane sign hashing in several tables, exact cosine verification, and distributed
connected components. Equal vectors are collapsed to one representative with a count first. A vector
goes to one bucket per table; inside a bucket, block by block, cosines are exact dot products in double precision. A pair counts in
the first table whose codes agree, so link counts are sums of what the buckets emit and no pair leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.components import connected_components
from eventide.llm.runs import runs
from eventide.llm.tables import written

CODE = np.uint32


def table_plan(n: int, cosine: float, bucket: int, recall: float) -> tuple[int, int]:
    """(bits, tables): bits bring a bucket of unrelated vectors to about `bucket`; tables bring the chance that
    a pair of exactly `cosine` shares a bucket to `recall` (closer pairs: more)."""
    bits = min(32, max(4, round(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def _codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Sign codes (rows, tables) of vectors of one dimension; the planes depend on seed and dimension only."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (CODE(1) << np.arange(bits, dtype=CODE))).sum(axis=2, dtype=CODE)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    bucket: int = 512, recall: float = 0.9999, block: int = 2048, seed: int = 7,
) -> DataFrame:
    """Per row of vectors: id, n_links, component_id, kept.

    Two rows link when the cosine of their vectors is at least `cosine`; a row's copies link with it. A
    vector that is null, empty, zero or holds a null or non-finite component links with nothing and is its own
    component. Vectors of different lengths never link. A row without an id links with nothing, has no component
    and is not kept. Rows that repeat an id with the same vector count as copies of each other and come back
    once each. A bucket with more than `block` vectors is dealt out as pairs of blocks, so one task holds two
    blocks at most and no bucket is capped.
    """
    v, x = F.col(vector_col), F.col("x")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound & F.col(id_col).isNotNull(), v).alias("x"))
    # a key of fixed width keeps the first aggregation in the hash form; the vector itself settles equality
    keyed = rows.withColumn("h", F.when(x.isNotNull(), F.xxhash64(F.transform(x, lambda c: c + F.lit(0)))))
    reps = written(keyed.filter("x is not null").groupBy("h", "x").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = reps.count()
    bits, tables = table_plan(n, cosine, bucket, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                flat = lists.take(pa.array(pick)).flatten().to_numpy().astype(np.float64)
                vec = flat.reshape(len(pick), d)
                codes = _codes(vec, bits, tables, seed)
                own = pa.array([c.tobytes() for c in codes], pa.binary())
                raw = pa.array([r.tobytes() for r in flat.astype(lists.type.value_type.to_pandas_dtype()).reshape(len(pick), d)], pa.binary())
                for t in range(tables):
                    key = (np.int64(d) << 42) + (np.int64(t) << 32) + codes[:, t].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(rep[pick]), pa.array(copies[pick]), own, raw], ["bucket", "rep", "copies", "codes", "vec"]
                    )

    kind = "float" if "float" in dict(vectors.dtypes)[vector_col] else "double"
    form = np.float32 if kind == "float" else np.float64
    source = reps.select("rep", "copies", F.col("x").cast(f"array<{kind}>"))
    posted = source.mapInArrow(hashed, "bucket long, rep long, copies long, codes binary, vec binary")
    # buckets over a block are dealt out as pairs of blocks
    large = posted.groupBy("bucket").count().filter(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = posted.join(large, "bucket", "left").withColumn("own_block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0)).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    dealt = dealt.select("bucket", "own_block", other, "rep", "copies", "codes", "vec").select(
        "bucket", F.least("own_block", "other").alias("one"), F.greatest("own_block", "other").alias("two"), "own_block", "rep", "copies", "codes", "vec"
    )
    parted = dealt.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "own_block", "rep")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            t = (int(part.column(0)[0].as_py()) >> 32) & 1023
            yield from _links(part, t, cosine, form)

    found = written(parted.mapInArrow(verified, "rep long, linked long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.select("rep", "root"), "rep", "root")
    members = reps.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h", F.col("x").alias("member_x"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = keyed.join(members, (keyed.h == members.h) & (x == F.col("member_x")), "left")
    own = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
    )


def _links(part: pa.RecordBatch, t: int, cosine: float, form: type) -> Iterator[pa.RecordBatch]:
    """Weighted link counts and a spanning star of each linked group, of one bucket or pair of blocks."""
    n = part.num_rows
    if n < 2:
        return
    block, rep, copies = (part.column(i).to_numpy() for i in (3, 4, 5))
    codes = np.frombuffer(b"".join(part.column(6).to_pylist()), CODE).reshape(n, -1)
    x = np.frombuffer(b"".join(part.column(7).to_pylist()), form).reshape(n, -1).astype(np.float64)
    # scaling by the largest component keeps the norms of very large and very small vectors finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    cut = int(np.searchsorted(block, block[0], "right"))
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pairs_of_blocks = part.column(1)[0] != part.column(2)[0]
    for at in range(0, cut if pairs_of_blocks else n, 512):
        end = min(at + 512, cut if pairs_of_blocks else n)
        lo = cut if pairs_of_blocks else at
        i, j = np.nonzero(x[at:end] @ x[lo:].T >= cosine)
        i, j = i + at, j + lo
        keep = i < j
        i, j = i[keep], j[keep]
        for cut_at in range(0, len(i), 1 << 18):
            a, b = i[cut_at : cut_at + (1 << 18)], j[cut_at : cut_at + (1 << 18)]
            fresh = ~(codes[a, :t] == codes[b, :t]).any(axis=1)
            rows.append(a[fresh])
            cols.append(b[fresh])
    i, j = np.concatenate(rows), np.concatenate(cols)
    if not len(i):
        return
    linked = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    root = np.arange(n)
    while True:  # smallest label over the links, with jumps
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(linked)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, rep)
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(linked[some].astype(np.int64)), pa.array(least[root[some]])], ["rep", "linked", "root"])
