"""Byte-level text work in numpy, shared by the text operators and used inside Arrow batches.

Everything works on the UTF-8 bytes of a batch of documents at once: word boundaries, word hashes,
shingles. A batch is walked in chunks of about `CHUNK` bytes (a longer document is one chunk), so a task
needs memory for one chunk of work arrays, whatever its partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = {_MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITE = ~WHITE
#: Letters and digits of ASCII and every byte of a longer character.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, nothing else changes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    if len(_powers[base]) < n:
        full = np.full(max(n, CHUNK), base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about `size` bytes."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of bytes of a kind, in order."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts = inside[:-1] & ~before[:-1]
    starts[edges] = inside[edges]
    ends = before & ~inside
    ends[edges] = before[edges]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; `span_hashes` takes differences of them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(_MULTIPLIER, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on nothing but the spans' bytes."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingles(hashes: np.ndarray, doc: np.ndarray, docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document) of every k consecutive words; a document of fewer words has all its words as one."""
    n = np.bincount(doc, minlength=docs)
    first = np.cumsum(n) - n
    at = np.arange(len(doc)) - first[doc]
    keep = (at + k <= n[doc]) | (at == 0)
    where, of = np.flatnonzero(keep), doc[keep]
    out = np.zeros(len(where), np.uint64)
    for j in range(k):
        spot = where + j
        there = at[where] + j < n[of]
        part = hashes[np.minimum(spot, len(hashes) - 1)] * (powers(_MULTIPLIER, 64)[7 * j + 3])
        out += np.where(there, part, np.uint64((j + 1) * int(_STEP) % (1 << 64)))
    return mix(out), of


def distinct_per_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value), sorted by document, then value."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], doc[new]
