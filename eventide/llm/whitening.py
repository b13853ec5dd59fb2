"""Whitening of embeddings from an exact integer covariance.

Method: entries become whole numbers; every distinct vector counts once. Within a block of rows each dimension, shifted by its
least value, is cut into bit planes that are packed across rows into 64-bit words. The number of common bits of two planes,
weighted by the two powers of two, adds up to the exact sum of products of two dimensions; shifts are undone in whole numbers.
The sums are added up by Spark as limbs of 40 bits, centred as integers (n times the products minus the products of the sums)
and only then turned to doubles for the symmetric eigenproblem. The driver holds d x d sums, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.tables import written

SCALE, COMPONENTS = 256, 4
#: Rows of a block (words are 64 rows) and bits of a limb of a sum.
BLOCK, LIMB = 4096, 40
_LIMBS = 5
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(256 c) as int64; what a 64-bit integer cannot hold becomes the nearest one, as in Spark's cast."""
    scaled = np.floor(entries.astype(np.float64) * SCALE)
    inside = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0))
    return np.where(scaled >= 2.0**63, np.int64(2**63 - 1), inside.astype(np.int64))


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 1, 2, 4 or 8 bytes an entry, so that equal rows have equal bytes."""
    width = np.zeros(len(x), np.int64)
    for i, kind in enumerate(_WIDTHS[:-1]):
        info = np.iinfo(kind)
        width[((x < info.min) | (x > info.max)).any(axis=1)] = i + 1
    out: list[bytes] = [b""] * len(x)
    for i, kind in enumerate(_WIDTHS):
        for row in np.flatnonzero(width == i):
            out[row] = x[row].astype(kind).tobytes()
    return out


def _unpacked(vectors: pa.Array, d: int) -> np.ndarray:
    """rows x d from packed rows; the length tells the width."""
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1].astype(np.int64)
    raw = np.frombuffer(vectors.buffers()[2], np.uint8)
    out = np.zeros((len(vectors), d), np.int64)
    size = np.diff(offsets)
    for kind in _WIDTHS:
        rows = np.flatnonzero(size == d * np.dtype(kind).itemsize)
        if len(rows):
            at = offsets[rows][:, None] + np.arange(d * np.dtype(kind).itemsize)
            out[rows] = raw[at].view(kind)
    return out


def valid_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and the packed whole numbers of the rows whose vector has every entry, written once; and the dimension.

    The dimension is the longest vector's. A null vector, or one that lacks entries (null, non-finite or shorter), is dropped.
    """
    size = embeddings.filter("embedding is not null").agg(F.max(F.size("embedding"))).first()[0]
    d = int(size or 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // max(d, 1))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                values = part.column(1).flatten()
                entries = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
                good = np.isfinite(entries).all(axis=1)
                x = whole_numbers(entries[good])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), pa.array(_packed(x), pa.binary())], ["vec_id", "x"])

    full = embeddings.filter((F.size("embedding") == d) & (F.size("embedding") > 0)).select("vec_id", "embedding")
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return written(full.mapInArrow(read, f"vec_id {kind}, x binary"), "whole_vectors"), d


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes x words of non-negative rows x d, and each plane's dimension and bit."""
    rows, d = y.shape
    padded = np.zeros((-(-rows // 64) * 64, d), np.uint64)
    padded[:rows] = y
    planes, of, bit = [], [], []
    for j in range(d):
        for b in range(int(padded[:, j].max()).bit_length() if rows else 0):
            bits = (padded[:, j] >> np.uint64(b) & np.uint64(1)).astype(np.uint8)
            planes.append(np.packbits(bits, bitorder="little").view(np.uint64))
            of.append(j)
            bit.append(b)
    words = np.array(planes, np.uint64) if planes else np.zeros((0, len(padded) // 64), np.uint64)
    return words, np.array(of, np.int64), np.array(bit, np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """Exact d x d sums of products of non-negative columns, from weighted counts of common bits; whole numbers of any size."""
    d = y.shape[1]
    words, of, bit = bit_planes(y)
    # 64-bit sums are exact while rows * 2^(bits of the two) stays below 2^62
    wide = 2 * (int(bit.max()) + 1 if len(bit) else 0) + len(y).bit_length() > 62
    out = np.zeros((d, d), object if wide else np.int64)
    for p in range(len(words)):
        common = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        weight = np.array([1 << int(b + bit[p]) for b in bit[p:]], object) if wide else np.int64(1) << (bit[p:] + bit[p])
        np.add.at(out, (of[p], of[p:]), common * weight)
    # a plane met each later plane once: pairs inside one dimension are still to be doubled, except of a plane with itself
    inner = np.diag(out).copy()
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    same = np.zeros(d, out.dtype)
    np.add.at(same, of, ones * (np.array([1 << int(2 * b) for b in bit], object) if wide else np.int64(1) << (2 * bit)))
    out = np.triu(out, 1)
    return out + out.T + np.diag(2 * inner - same)


def _block_sums(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of each dimension and of the products of dimensions i <= j of a block, as whole numbers."""
    least = x.min(axis=0)
    y = (x.astype(object) - least.astype(object)).astype(np.uint64) if int(x.max()) - int(x.min()) >= 1 << 62 else (x - least).astype(np.uint64)
    n, m = len(x), [int(v) for v in least]
    xy = products(y)
    s = [sum(int(v) for v in y[:, j]) if y.dtype == object or int(y[:, j].max()) >> 48 else int(y[:, j].sum()) for j in range(x.shape[1])]
    sums = [v + n * m_j for v, m_j in zip(s, m, strict=True)]
    return sums, [[int(xy[i, j]) + m[i] * s[j] + m[j] * s[i] + n * m[i] * m[j] for j in range(i, x.shape[1])] for i in range(x.shape[1])]


def _limbs(value: int) -> list[int]:
    """Low limbs of LIMB bits and a signed top limb."""
    return [value >> LIMB * i & (1 << LIMB) - 1 for i in range(_LIMBS - 1)] + [value >> LIMB * (_LIMBS - 1)]


@dataclass(frozen=True)
class Moments:
    """Of the distinct vectors: their number, exact sums, and V's numerators n * products - sums * sums (divisor n * n)."""

    n: int
    sums: list[int]
    scatter: list[list[int]]


def moments(vectors: DataFrame, d: int) -> Moments:
    """Exact moments of the distinct packed vectors."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, held = None, 0, []

        def add(x: np.ndarray) -> None:
            nonlocal total, rows
            sums, xx = _block_sums(x)
            block = [*sums, *(v for row in xx for v in row)]
            total = block if total is None else [a + b for a, b in zip(total, block, strict=True)]
            rows += len(x)

        for batch in batches:
            if batch.num_rows:
                held.append(_unpacked(batch.column(0), d))
            if sum(map(len, held)) >= BLOCK:
                x = np.concatenate(held)
                full = len(x) // BLOCK * BLOCK
                for first in range(0, full, BLOCK):
                    add(x[first : first + BLOCK])
                held = [x[full:]]
        if sum(map(len, held)):
            add(np.concatenate(held))
        if total is not None:
            values = np.array([_limbs(v) for v in [rows, *total]], np.int64)
            columns = [pa.array(np.arange(len(values)))] + [pa.array(values[:, i]) for i in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays(columns, ["place", *(f"limb{i}" for i in range(_LIMBS))])

    names = [f"limb{i}" for i in range(_LIMBS)]
    parts = vectors.mapInArrow(scatter, "place long, " + ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values("place")
    values = [sum(int(v) << LIMB * i for i, v in enumerate(row)) for row in found[names].itertuples(index=False)]
    if not values:
        return Moments(0, [0] * d, [[0] * d for _ in range(d)])
    n, sums, flat = values[0], values[1 : d + 1], iter(values[d + 1 :])
    full = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            full[i][j] = full[j][i] = n * next(flat) - sums[i] * sums[j]
    return Moments(n, sums, full)


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors of V as columns, 1 / sqrt(eigenvalue) (0 for a direction without variance), shares of the trace."""

    moments: Moments
    axes: np.ndarray
    inverse_root: np.ndarray
    explained: np.ndarray


def fit(m: Moments, components: int = COMPONENTS) -> Whitening:
    d = len(m.sums)
    trace = sum(m.scatter[i][i] for i in range(d))
    k = min(components, d)
    if not trace:
        return Whitening(m, np.eye(d)[:, :k], np.zeros(k), np.zeros(k))
    # quotients of whole numbers are rounded once; V is scaled by its trace so that no size of entries leaves the range of doubles
    share = np.array([[v / trace for v in row] for row in m.scatter])
    e, axes = np.linalg.eigh(share)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    some = e > d * np.finfo(float).eps * e[0]
    root = np.sqrt(np.where(some, e, 1.0)) * _root(trace, m.n)
    return Whitening(m, axes, np.where(some, 1 / root, 0.0), np.maximum(e, 0.0))


def _root(trace: int, n: int) -> float:
    """sqrt(trace(V)) = sqrt(trace of the numerators) / n."""
    return (trace / (n * n)) ** 0.5


def _deviations(x: np.ndarray, m: Moments) -> tuple[np.ndarray, list[int | None]]:
    """(x - S / n) as doubles, rounded once per entry, and the exact sum of squares of n x - S (None beyond 64 bits)."""
    far = m.n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(map(abs, m.sums))
    if far < 1 << 53 and far * far * x.shape[1] < 1 << 63:
        off = m.n * x - np.array(m.sums, np.int64)
        return off / m.n, (off * off).sum(axis=1).tolist()
    off = m.n * x.astype(object) - np.array(m.sums, object)
    squares = [int(v) for v in (off * off).sum(axis=1)]
    return np.array([[v / m.n for v in row] for row in off], float), [v if v < 1 << 63 else None for v in squares]


def _projected(vectors: DataFrame, w: Whitening, with_id: bool) -> DataFrame:
    """Per row of packed vectors: its deviation and its whitened components (w1, w2, ...)."""
    d, k = w.axes.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off, squares = _deviations(_unpacked(batch.column(batch.num_columns - 1), d), w.moments)
                white = off @ w.axes * w.inverse_root
                ids = [batch.column(0)] if with_id else []
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(squares, pa.int64()), *(pa.array(np.ascontiguousarray(white[:, c])) for c in range(k))],
                    [*(["vec_id"] if with_id else []), "deviation", *(f"w{c + 1}" for c in range(k))],
                )

    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, " if with_id else ""
    return vectors.mapInArrow(read, kind + "deviation long, " + ", ".join(f"w{c + 1} double" for c in range(k)))


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per remaining row and component.

    Repeated rows stay rows of their own and count once in the fit; null ids are kept. A vector shorter than the longest one is
    dropped like one with a null entry. With fewer than `components` dimensions there are as many components as dimensions. A
    component without variance has whitened 0 (so identity_error is 1) and, if no vector varies, explained 0. A deviation that 64
    bits cannot hold is null. An empty table, or one without a valid vector, gives an empty table; other columns are not read.
    """
    rows, d = valid_vectors(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = written(rows.select("x").distinct(), "distinct_vectors")
    m = moments(distinct, d)
    if not m.n or not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    w = fit(m, components)
    names = [f"w{c + 1}" for c in range(w.axes.shape[1])]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    spread = _projected(distinct, w, False).agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    error = max(abs(v - (a == b)) for v, (a, b) in zip(spread, pairs, strict=True))
    per_component = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(w.explained[i])).alias("explained")) for i, c in enumerate(names)
    ])).alias("c")
    return _projected(rows, w, True).select("vec_id", "deviation", per_component).select(
        "vec_id", "c.component", F.lit(m.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")
    )
