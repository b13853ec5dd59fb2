"""Benchmark passages in documents, up to a share of edits.

Method: pigeonhole edit matching. A test item with an error budget of k edits is split into k + 1 pieces; any
passage within the budget holds one piece unchanged. The principle also holds at every level of a tree of halves:
some unchanged piece lies in a run of 2 pieces with 1 edit at most, this in a run of 4 with 3, and so on. The pieces' exact hits are
found on the bytes of whole texts. Around a hit, the other pieces of the smallest run are cut in halves, of which enough must stand unchanged near their
places; then the surroundings are verified level by level, up to the whole item, with Myers' bit-parallel edit distance. Documents are read in one
narrow pass per block of items; nothing is shuffled but the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import rows_with, written

#: Bytes of a piece that are looked up, and the shortest piece in characters.
HEAD = 8
_BITS = 22
#: A-Z lower-cased, ASCII white space as a space.
_NORMAL = np.where(tk.WHITE, np.uint8(0x20), tk.LOWER)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, and every run of ASCII white space as one space."""
    out = _NORMAL[data]
    white = out == 0x20
    again = np.zeros(len(out), bool)
    again[1:] = white[1:] & white[:-1]
    again[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    dropped = np.flatnonzero(again)
    return np.delete(out, dropped), offsets - np.searchsorted(dropped, offsets)


def normal_text(text: str) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    return normal(data, np.array([0, len(data)]))[0].tobytes().decode().strip(" ")


def _runs_around(i: int, n: int) -> list[tuple[int, int]]:
    """The runs of a tree of halves over n pieces that hold piece i, from small to large, without the piece and the whole."""
    lo, hi, out = 0, n, []
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if i < mid else (mid, hi)
    return out[:0:-1]


def _window(raw: bytes, a: int, b: int, low: int, high: int) -> tuple[int, int]:
    """The span cut to a document and widened to whole characters."""
    a, b = max(a, low), min(b, high)
    while a > low and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < high and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def _halves(text: str, k: int, run: tuple[int, int, int, int, int]) -> list[tuple[int, bytes]]:
    """(first byte, counted from the piece that was hit; bytes) of the halves of the other pieces of a run in an item of k edits.

    An edit changes one half at most, so a run of r pieces within r - 1 edits has r + 1 unchanged halves, r - 1 of them outside the
    piece that was hit.
    """
    first, end, before, *_ = run
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if first <= a < end and len(text[first:a].encode()) != before:
            mid = (a + b) // 2
            out += [(len(text[first:x].encode()) - before, text[x:y].encode()) for x, y in ((a, mid), (mid, b))]
    return out


def _near(raw: bytes, p: int, low: int, high: int, halves: list[tuple[int, bytes]], most: int) -> bool:
    """Whether `most` of the halves stand unchanged near their places; an edit moves them by a character, that is by 4 bytes at most."""
    there = 0
    for at, half in halves:
        start = p + at - 4 * most
        there += raw.find(half, max(low, start), min(high, start + len(half) + 8 * most)) >= 0
    return there >= most


def _holds(raw: bytes, p: int, low: int, high: int, n: int, index: Pieces, i: int, matchers: dict) -> bool:
    """Whether every run around a hit of piece i at byte p keeps within its edits."""
    if index.runs[i]:
        if (halves := matchers.get(("halves", i))) is None:
            halves = matchers["halves", i] = _halves(*index.items[n][1:], index.runs[i][0])
        if not _near(raw, p, low, high, halves, index.runs[i][0][4]):
            return False
    for first, end, before, after, most in index.runs[i]:
        if (matcher := matchers.get((n, first, end))) is None:
            matcher = matchers[n, first, end] = Myers(index.items[n][1][first:end])
        margin = most if raw[max(low, p - before - most) : p + after + most].isascii() else 4 * most
        a, b = _window(raw, p - before - margin, p + after + margin, low, high)
        if matcher.best(raw[a:b].decode())[0] > most:
            return False
    return True


class Myers:
    """Least edit distance of a pattern to any part of a text, a character at a time on words as wide as the pattern."""

    def __init__(self, pattern: str):
        self.size, self.all, self.high = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the part) of the first best part."""
        plus, minus, now, every, high, where = self.all, 0, self.size, self.all, self.high, self.where
        best, end = now, 0
        for at, c in enumerate(text, 1):
            same = where.get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | (every & ~(horizontal | plus))
            down = plus & horizontal
            if up & high:
                now += 1
            elif down & high:
                now -= 1
                if now < best:
                    best, end = now, at
            up, down = (up << 1) & every, (down << 1) & every
            plus = down | (every & ~(vertical | up))
            minus = up & vertical
        return best, end


@dataclass
class Pieces:
    """The items of a block: ids, matchers, byte lengths, budgets; their pieces by the first HEAD bytes, with their sizes and last bytes; short items by text."""

    items: list[tuple[int, str, int]]
    heads: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bodies: list[bytes]
    sizes: np.ndarray
    last: np.ndarray
    runs: list[list[tuple[int, int, int, int, int]]]
    """Per piece, the runs of pieces that hold it, from small to large: (first character, end, bytes of the run before the piece, bytes
    from the piece on, most edits)."""
    bitmap: np.ndarray
    whole: dict[bytes, list[int]]


def _slot(heads: np.ndarray) -> np.ndarray:
    return ((heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def pieces(items: list[tuple[int, str]], rate: float) -> Pieces:
    """Split each item of m characters with budget k = rate * m into k + 1 pieces of HEAD characters or more."""
    kept, rows, whole = [], [], {}
    for item_id, text in items:
        text = normal_text(text)
        m = len(text)
        if m < HEAD:
            if text:
                whole.setdefault(text.encode(), []).append(item_id)
            continue
        k = min(int(rate * m), m // HEAD - 1)
        cuts = [m * i // (k + 1) for i in range(k + 2)]
        at = [len(text[:c].encode()) for c in cuts]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            body = text[a:b].encode()
            runs = [(cuts[lo], cuts[hi], at[i] - at[lo], at[hi] - at[i], hi - lo - 1) for lo, hi in _runs_around(i, k + 1)]
            rows.append((int.from_bytes(body[:HEAD], "little"), len(kept), at[i], body, runs))
        kept.append((item_id, text, k))
    rows.sort(key=lambda r: r[0])
    heads = np.array([r[0] for r in rows], np.uint64)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[_slot(heads)] = True
    item, at = (np.array([r[j] for r in rows], np.int64) for j in (1, 2))
    bodies = [r[3] for r in rows]
    sizes, last = np.array([len(b) for b in bodies], np.int64), np.array([b[-1] for b in bodies], np.uint8)
    return Pieces(kept, heads, item, at, bodies, sizes, last, [r[4] for r in rows], bitmap, whole)


def matches(data: np.ndarray, offsets: np.ndarray, index: Pieces, matchers: dict) -> Iterator[tuple[int, int, int, int]]:
    """(document, item number or -1 - item id of a short item, distance, byte after the passage) of a chunk, best per document and item."""
    text, offsets = normal(data, offsets)
    if index.whole:
        for d in np.flatnonzero(np.diff(offsets) < 4 * HEAD + 2):
            for item_id in index.whole.get(text[offsets[d] : offsets[d + 1]].tobytes().strip(b" "), ()):
                yield int(d), -1 - item_id, 0, int(offsets[d + 1] - offsets[d])
    if not len(index.heads) or len(text) < HEAD:
        return
    raw = text.tobytes()
    heads = np.ndarray((len(text) - HEAD + 1,), "<u8", raw, strides=(1,))
    place = np.flatnonzero(index.bitmap[_slot(heads)])
    first = np.searchsorted(index.heads, heads[place], "left")
    last = np.searchsorted(index.heads, heads[place], "right")
    hits: dict[tuple[int, int], list[int]] = {}
    many = last - first
    spot, piece = np.repeat(place, many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    docs = np.searchsorted(offsets, spot, "right") - 1
    ends = spot + index.sizes[piece]
    # most pieces end a byte or two after their head, so that their last byte leaves few places
    likely = (ends <= offsets[docs + 1]) & (text[np.minimum(ends, len(text)) - 1] == index.last[piece])
    spot, piece, docs = spot[likely], piece[likely], docs[likely]
    for p, i, d, low, high in zip(*(c.tolist() for c in (spot, piece, docs, offsets[docs], offsets[docs + 1])), strict=True):
        if raw.startswith(index.bodies[i], p):
            n = int(index.item[i])
            start, known = p - int(index.at[i]), hits.get((d, n))
            # the pieces of a passage that is found already tell nothing new; its window is judged below
            if known and abs(start - known[-1]) <= index.items[n][2]:
                known.append(start)
            elif _holds(raw, p, low, high, n, index, i, matchers):
                hits.setdefault((d, n), []).append(start)
    for (d, n), starts in hits.items():
        _, pattern, k = index.items[n]
        size = len(pattern.encode())
        if n not in matchers:
            matchers[n] = Myers(pattern)
        best, end, done = k + 1, 0, -1
        for start in sorted(starts):
            # an edit moves the rest of a passage by a character, that is by 4 bytes at most
            margin = k if raw[max(0, start - 4 * k) : start + size + 8 * k].isascii() else 4 * k
            if start + size + margin <= done:
                continue
            # one window for this hit and all that start within a margin of it
            a, b = _window(raw, start - margin, start + size + 2 * margin, int(offsets[d]), int(offsets[d + 1]))
            window = raw[a:b].decode()
            distance, stop = matchers[n].best(window)
            done = b
            if distance < best:
                best, end = distance, a + len(window[:stop].encode()) - int(offsets[d])
            if best == 0:
                break
        if best <= k:
            yield d, n, best, end


def _blocks(benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[Pieces]:
    """The items in blocks of about block_chars characters, one block at least."""
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        yield pieces(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)), rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, distance, budget, passage_end.

    A passage matches when its edit distance to the whole item, in characters after lower-casing A-Z and joining white
    space, is at most rate times the item's length (less for items so short that pieces would fall under 8 characters;
    an item under 8 characters matches only a text that equals it). passage_end is the byte of the normalised text
    after the best passage. Null, empty and blank texts and items match nothing; a null doc_id is kept; repeated rows
    and items give a row each. Items are taken in blocks of about block_chars characters, each a pass over the documents,
    so what goes to the tasks is bounded however large the benchmark is.
    """
    return reduce(DataFrame.union, [_scan(docs, index) for index in _blocks(benchmark, rate, block_chars)])


def _scan(docs: DataFrame, index: Pieces) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, matchers = shared.value, {}
        for batch in batches:
            ids, rows = batch.column(0), []
            for first, _, data, offsets in tk.chunks(batch.column(1)):
                for d, n, distance, end in matches(data, offsets, index, matchers):
                    item_id, budget = (-1 - n, 0) if n < 0 else (index.items[n][0], index.items[n][2])
                    rows.append((ids[first + d].as_py(), item_id, distance, budget, end))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "budget", "passage_end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, item_id long, distance long, budget long, passage_end long")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs in which no benchmark item is found, with their columns. Every row is judged by itself, whether its doc_id is
    null or occurs again, in one narrow pass per block; between blocks the rows that are left are written."""
    for number, index in enumerate(_blocks(benchmark, rate, block_chars)):
        docs = _without(written(docs, "clean") if number else docs, index)
    return docs


def _without(docs: DataFrame, index: Pieces) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def keep(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        matchers: dict = {}
        for first, end, data, offsets in tk.chunks(column):
            marks = np.ones(end - first, bool)
            for d, *_ in matches(data, offsets, shared.value, matchers):
                marks[d] = False
            yield first, marks

    return rows_with(docs, keep)
