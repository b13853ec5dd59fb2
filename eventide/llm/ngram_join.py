"""Self-join of documents on the Jaccard similarity of their word n-gram sets, up to connected components.

Method: set-relation skipping. A set is indexed under its rarest tokens only (the prefix that any partner must
meet). Two relations between sets save work:

* index level: entries of a token's list are blocked by position; a block whose positions leave too few tokens
  for the required overlap, or whose sizes do not fit, is skipped whole;
* answer level: a set that is highly similar to a leader takes its answers from the leader's: with the
  tokens it lacks and adds against the leader, its overlap with any set follows from the leader's overlap, and most
  answers are settled by that bound alone. Pairs that are already connected need no answer: each component first has
  its likeliest pairs answered, and all pairs that still run between components come after these have joined.

Equal sets are one node from the start. Nothing is capped: a list longer than a block is dealt out as pairs of
blocks. The hash-ordered prefix is refined by a bounded list of common tokens that go last; the order changes the
amount of work only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.components import connected_components
from eventide.llm.id_filter import id_bitmap, wanted
from eventide.llm.tables import small_batches, written

HASHES = 16
#: Bytes of text that a task works on at once; several arrays of 8 bytes a byte of text exist at a time.
TEXT = 1 << 17
#: Tokens per window in which a mapper looks for common ones; how often one must occur there; how many are kept.
WINDOW, SEEN, COMMON = 1_000_000, 3, 100_000
#: Longest list, and most members of a leader, that one task handles as a unit.
BLOCK, MEMBERS = 4096, 256
#: Pairs that each component has answered, per batch of lists, before all pairs between components are looked at.
LIKELY = 8
#: 64-bit words of a parity bitmap, at most, inside the lists.
WORDS = 32
_FACTORS = tk.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_MINS = [f"m{i}" for i in range(HASHES)]


def token_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first row, distinct tokens sorted by document, their local documents, set sizes, set ids.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; tokens are hashes of k
    consecutive words. A set id is a 64-bit hash of the whole set and its size.
    """
    for first, end, data, offsets in tk.chunks(column, TEXT):
        lowered = tk.LOWER[data]
        starts, ends, doc = tk.words(lowered, offsets, tk.NOT_WHITE)
        n_docs = end - first
        hashes = tk.span_hashes(tk.prefix_hashes(lowered), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        tokens, of = tk.shingles(hashes, doc, n_docs, k) if len(starts) else (hashes, doc)
        tokens, of = tk.distinct_per_doc(tokens, of)
        sizes = np.bincount(of, minlength=n_docs)
        sums = np.zeros(n_docs, np.uint64)
        some = np.flatnonzero(sizes)
        if len(some):
            sums[some] = np.add.reduceat(tk.mix(tokens), (np.cumsum(sizes) - sizes)[some])
        yield first, tokens, of, sizes, tk.mix(sums + sizes.astype(np.uint64) * tk._STEP).view(np.int64)


def parity_bitmaps(tokens: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per set, WORDS * 64 bits; a bit is the parity of the tokens that hash to it.

    Tokens that two sets share cancel out, so differing bits never outnumber the tokens of the symmetric difference.
    """
    width = 64 * WORDS
    out = np.empty((n, WORDS), np.uint64)
    for at in range(0, n, 1024):
        rows = min(1024, n - at)
        lo, hi = np.searchsorted(of, [at, at + rows])
        place = (of[lo:hi] - at) * width + (tokens[lo:hi] % np.uint64(width)).astype(np.int64)
        odd = (np.bincount(place, minlength=rows * width) & 1).astype(bool)
        out[at : at + rows] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(rows, WORDS)
    return out


def fold(bits: np.ndarray, words: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps, padded with zeros, of `words` words each, cut to `to` words: the halves of a parity bitmap add up bit by bit."""
    out = bits.copy()
    words = words.copy()
    while (words > to).any():
        w = int(words.max())
        rows = np.flatnonzero(words == w)
        out[rows, : w // 2] ^= out[rows, w // 2 : w]
        out[rows, w // 2 : w] = 0
        words[rows] = w // 2
    return out[:, :to]


def sized_bitmaps(tokens: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set a parity bitmap of as many bits as it has tokens (the next power of two, one word at least): wide enough to tell
    sets apart, and an eighth of a byte a token."""
    n = len(sizes)
    bits = parity_bitmaps(tokens, of, n)
    words = np.maximum(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 64) // 64
    at = np.concatenate(([0], np.cumsum(sizes)))
    out: list[bytes] = [b""] * n
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        if w <= WORDS:
            for r, b in zip(rows.tolist(), fold(bits[rows], np.full(len(rows), WORDS), w), strict=True):
                out[r] = b.tobytes()
        else:
            for r in rows.tolist():
                odd = (np.bincount((tokens[at[r] : at[r + 1]] % np.uint64(64 * w)).astype(np.int64), minlength=64 * w) & 1).astype(bool)
                out[r] = np.packbits(odd, bitorder="little").tobytes()
    return out


def bitmap_rows(column: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of different lengths as rows padded with zeros, and their words; longer ones than `most` words are folded."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    words = np.diff(offsets) // 8
    out = np.zeros((len(column), most or int(words.max(initial=1))), np.uint64)
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        wide = raw[offsets[rows][:, None] + np.arange(8 * w)].view(np.uint64)
        k = min(w, out.shape[1])
        out[rows, :k] = fold(wide, np.full(len(rows), w), k)
    return out, np.minimum(words, out.shape[1])


def may_link(size: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, words: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets the bitmaps leave open: their bound on the intersection reaches the required one."""
    return most_common(size, bits, i, j, words) >= required(size[i], size[j], percent)


def most_common(size: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The most tokens that each pair can share; bitmaps of different widths are compared at the smaller one."""
    if words is None:
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    else:
        differ = np.zeros(len(i), np.int64)
        least = np.minimum(words[i], words[j])
        for w in np.unique(least).tolist():
            at = np.flatnonzero(least == w)
            a, b = (fold(bits[x[at]], words[x[at]], w) for x in (i, j))
            differ[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (size[i] + size[j] - differ) // 2


def required(a, b, percent: int):
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def frequent(window: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur SEEN times or more in a window, sorted, and how often. The window is emptied, and sorted in place: it is
    the largest array that a mapper holds."""
    values = np.concatenate(window) if window else np.zeros(0, np.uint64)
    window.clear()
    values.sort()
    tokens = values[: max(0, len(values) - SEEN + 1)]
    tokens = tokens[tokens == values[SEEN - 1 :]]
    tokens = np.unique(tokens)
    return tokens, np.searchsorted(values, tokens, "right") - np.searchsorted(values, tokens, "left")


def _with_ids(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows with an id, in slices, so that long texts are copied a few at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.filter(part.column(0).is_valid()) if part.column(0).null_count else part


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per document: set id (null for an empty set), size, min-hashes, parity bitmap. Further rows, without a set, hold tokens
    that are common inside a mapper's window, with their count there."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = [], 0
        for batch in batches:
            ids = batch.column(0)
            for first, tokens, of, sizes, set_ids in token_sets(batch.column(1), k):
                some = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[some]
                mins = np.zeros((HASHES, len(sizes)), np.int64)
                for i in range(HASHES if len(some) else 0):
                    mins[i, some] = np.minimum.reduceat(tokens * _FACTORS[i], at).view(np.int64)
                none = pa.nulls(len(sizes), pa.int64())
                columns = [ids.slice(first, len(sizes)), pa.array(set_ids, mask=sizes == 0), pa.array(sizes), *map(pa.array, mins), none, none, pa.array(sized_bitmaps(tokens, of, sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                window.append(tokens)
                held += len(tokens)
                if held >= WINDOW:
                    yield from common(window)
                    held = 0
        yield from common(window)

    def common(window: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, count = frequent(window)
        if len(tokens):
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * (3 + HASHES) + [pa.array(tokens.view(np.int64)), pa.array(count), pa.nulls(len(tokens), pa.binary())], names)

    names = ["doc_id", "set_id", "n", *_MINS, "token", "seen", "bitmap"]
    return docs.select("doc_id", "text").mapInArrow(sign, ", ".join(f"{c} long" for c in names[:-1]) + ", bitmap binary")


def common_tokens(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common tokens, sorted, and their rank by count; at most COMMON of them reach the driver."""
    top = signed.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter("seen >= 32")
    top = top.orderBy(F.desc("seen"), "token").limit(COMMON).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - 1 - np.arange(len(tokens)))[order].astype(np.uint64)


def prefixes(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, set_id, size and position in one number) of every set's prefix; equal sets of a batch once."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = common
        for batch in batches:
            chunks = (chunk for part in _with_ids(batch) for chunk in token_sets(part.column(1), k))
            for _, tokens, of, sizes, set_ids in chunks:
                one = np.zeros(len(sizes), bool)
                one[np.unique(set_ids, return_index=True)[1]] = True
                keep = one[of]
                tokens, of = tokens[keep], of[keep]
                order = tokens >> np.uint64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    order = np.where(known[at] == tokens, rank[at] + np.uint64(1 << 63), order)
                by = np.lexsort((order, of))
                tokens, of = tokens[by], of[by]
                kept = np.where(one, sizes, 0)
                position = np.arange(len(of)) - (np.cumsum(kept) - kept)[of]
                size = sizes[of]
                keep = position < size - (percent * size + 99) // 100 + 1
                packed = (size[keep].astype(np.int64) << 32) | position[keep]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(set_ids[of[keep]]), pa.array(packed)], ["token", "set_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(index, "token long, set_id long, packed long")


def shared_lists(postings: DataFrame) -> DataFrame:
    """Entries of the tokens that more than one set has. A list longer than a block is passed on as it streams."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_token = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # tokens are sorted
            yield from lists(rows[:, :last], long_token)
            held = rows[:, last:]
            if rows[0, -1] != long_token:
                long_token = None if held.shape[1] <= BLOCK else rows[0, -1]
            if long_token is not None:
                yield from lists(held, long_token)
                held = None
        if held is not None:
            yield from lists(held, long_token)

    def lists(rows: np.ndarray, long_token: int | None) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, new]
        start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        size = np.diff(np.append(start, rows.shape[1]))
        pick = np.repeat(size, size) > 1
        if long_token is not None:
            pick |= rows[0] == long_token
        if pick.any():
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows[:, pick])], ["token", "set_id", "packed"])

    sorted_lists = postings.repartition("token").sortWithinPartitions("token", "set_id")
    return sorted_lists.mapInArrow(keep, "token long, set_id long, packed long")


def candidate_units(entries: DataFrame, info: DataFrame, marks: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """Distinct pairs (ua < ub) of leaders some of whose sets may be similar and are not connected yet.

    Lists whose sets are all connected already are dropped; the sets of the others bring their bitmaps along, so a pair is
    only emitted when sizes, positions and bitmaps leave it open. With `best`, only the pairs that are among the `best` likeliest of
    one of their components in the lists that a task holds at once: they grow with the components there, not with pairs.
    """
    rows = written(entries.join(info, "set_id").select("token", "set_id", "packed", F.coalesce("unit", "set_id").alias("unit"), "component"), "placed")
    crossing = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("count")).filter("lo <> hi")
    crossing = crossing.select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(crossing, "token").join(_folded(marks), "set_id")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("token", "side", other, "unit", "component", "packed", "bitmap").select(
        "token", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "unit", "component", "packed", "bitmap"
    )
    parted = rows.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "side", "unit")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])
            bits, words = bitmap_rows(batch.column(7), WORDS)
            rows = np.concatenate([rows, words[None, :]])
            if held is not None:
                rows, bits = np.concatenate([held[0], rows], axis=1), np.concatenate([held[1], bits])
            before = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
            last = int(before[-1]) + 1 if len(before) else 0
            found.append(_list_pairs(rows[:, :last], bits[:last], percent, best))
            n += found[-1].shape[1]
            held = rows[:, last:], bits[last:]
            if n > 200_000:
                yield from out(found)
                found, n = [], 0
        if held is not None:
            found.append(_list_pairs(*held, percent, best))
        yield from out(found)

    def out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found and (both := np.unique(np.concatenate(found, axis=1), axis=1)).shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["ua", "ub"])

    return parted.mapInArrow(pairs, "ua long, ub long").distinct()


def _folded(marks: DataFrame) -> DataFrame:
    """set_id and its bitmap, WORDS words at most: lists carry one with every entry."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, words = bitmap_rows(batch.column(1), WORDS)
            short = pa.array([b[:w].tobytes() for b, w in zip(bits, words.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), short], ["set_id", "bitmap"])

    return marks.select("set_id", "bitmap").mapInArrow(cut, "set_id long, bitmap binary")


def _likeliest(comp: np.ndarray, pairs: np.ndarray, most: int) -> np.ndarray:
    """Of the rows i, j, open (how far the overlap may exceed the required one) the pairs that are among the `most` most open ones of
    one of their components."""
    ends = np.concatenate([comp[pairs[0]], comp[pairs[1]]])
    by = np.lexsort((-np.tile(pairs[2], 2), ends))
    ends = ends[by]
    top = np.ones(len(by), bool)
    top[most:] = ends[most:] != ends[:-most]
    return pairs[:, np.unique(by[top] % max(1, pairs.shape[1]))]


def _list_pairs(rows: np.ndarray, bits: np.ndarray, percent: int, best: int | None = None, short: int = 32) -> np.ndarray:
    """Candidate unit pairs of whole lists, sorted by key, side and unit; with `best`, the `best` likeliest ones of each component."""
    n = rows.shape[1]
    if n < 2:
        return np.zeros((2, 0), np.int64)
    new = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    _, one, two, side, unit, comp, packed, words = rows
    size, rest = packed >> 32, (packed >> 32) - (packed & 0xFFFFFFFF)
    across = one != two
    found = [np.zeros((3, 0), np.int64)]
    idx = np.flatnonzero(count[group] <= short)
    for step in range(1, short):
        i, j = idx[:-step], idx[step:]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        keep = (comp[i] != comp[j]) & ~(across[i] & (side[i] == side[j]))
        keep &= np.minimum(rest[i], rest[j]) >= required(size[i], size[j], percent)
        found.append(_open(size, bits, i[keep], j[keep], percent, words))
    starts = np.flatnonzero(new)
    for g in np.flatnonzero(count > short):
        at = slice(starts[g], starts[g] + count[g])
        pairs = _long_list(unit[at], comp[at], size[at], rest[at], side[at], bits[at], words[at], bool(across[starts[g]]), percent, best)
        found.append(pairs + np.array([[starts[g]], [starts[g]], [0]]))
    pairs = np.concatenate(found, axis=1)
    return _units(unit, _likeliest(comp, pairs, best) if best else pairs)


def _open(size, bits, i: np.ndarray, j: np.ndarray, percent: int, words: np.ndarray) -> np.ndarray:
    """Of the pairs i, j those that the bitmaps leave open, and by how much their bound exceeds the required overlap."""
    over = most_common(size, bits, i, j, words) - required(size[i], size[j], percent)
    return np.stack([i, j, over])[:, over >= 0]


def _units(unit: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The distinct pairs of units of pairs of rows."""
    return np.unique(np.sort(unit[pairs[:2]], axis=0), axis=1)


def _long_list(unit, comp, size, rest, side, bits, words, across: bool, percent: int, best: int | None, block: int = 256) -> np.ndarray:
    """Rows i, j, open of one long list, a pair of units once a block, ordered by position and cut in blocks; two blocks are skipped
    when the tokens that their positions leave cannot reach the overlap that their sizes require."""
    found = [np.zeros((3, 0), np.int64)]
    by = np.argsort(-rest, kind="stable")
    size, rest, unit, comp, side, bits, words = (x[by] for x in (size, rest, unit, comp, side, bits, words))
    edges = list(range(0, len(unit), block))
    low = np.minimum.reduceat(size, edges)
    for p, a in enumerate(edges):
        for q in range(p, len(edges)):
            b = edges[q]
            if rest[b] < required(low[p], low[q], percent):  # rest falls from block to block
                continue
            x, y = np.arange(a, min(a + block, len(unit))), np.arange(b, min(b + block, len(unit)))
            ok = np.minimum(rest[x][:, None], rest[y]) >= required(size[x][:, None], size[y], percent)
            ok &= comp[x][:, None] != comp[y]
            if across:
                ok &= side[x][:, None] != side[y]
            if p == q:
                ok &= x[:, None] < y
            i, j = np.nonzero(ok)
            pairs = _open(size, bits, x[i], y[j], percent, words)
            once = np.unique(np.sort(unit[pairs[:2]], axis=0), axis=1, return_index=True)[1]
            found.append(_likeliest(comp, pairs, best) if best else pairs[:, once])
    pairs = np.concatenate(found, axis=1)
    pairs[:2] = by[pairs[:2]]
    return pairs


def tokens_of(docs: DataFrame, sets: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(set_id, tokens) of the wanted set ids, from one document of each; other texts are not shuffled."""
    want = written(sets.join(ids.distinct(), "set_id", "left_semi").select("set_id", F.col("rep").alias("want_rep")), "wanted")
    bitmap = id_bitmap(want, "want_rep")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _with_ids(batch):
                part = part.filter(pa.array(wanted(bitmap, part.column(0).to_numpy())))
                for first, tokens, of, sizes, set_ids in token_sets(part.column(1), k):
                    at = np.concatenate(([0], np.cumsum(sizes)))
                    raw = [tokens[at[i] : at[i + 1]].tobytes() for i in range(len(sizes))]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(sizes)), pa.array(set_ids), pa.array(raw, pa.binary())], ["rep", "set_id", "tokens"])

    read_sets = docs.select("doc_id", "text").mapInArrow(read, "rep long, set_id long, tokens binary")
    return read_sets.join(want, (read_sets.set_id == want.set_id) & (F.col("rep") == F.col("want_rep"))).select(read_sets.set_id, "tokens")


def _both(pairs: DataFrame, tokens: DataFrame, a: str, b: str) -> DataFrame:
    one = tokens.select(F.col("set_id").alias(a), F.col("tokens").alias("ta"))
    two = tokens.select(F.col("set_id").alias(b), F.col("tokens").alias("tb"))
    return pairs.join(one, a).join(two, b)


def _set(raw: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b; both sorted."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def _sketch() -> Column:
    """A byte of each min-hash, in one binary value: enough to rank leaders, which only decides the amount of work."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(m, F.lit(256))), 2, "0") for m in _MINS]))


def likely_pairs(sets: DataFrame, runs: int = 4, parts: int = 8, equal: int = 8, kept: int = 3) -> DataFrame:
    """(a, leader): each set with the most central sets of every run of equal min-hashes that it is in, one for each
    hashed part of the run.

    A set's centrality is the number of sets that share its min-hashes: in a group of edited copies, the least edited
    ones share the most, and a copy is similar to them if to any. Of a set's leaders with `equal` equal min-hashes or more, the
    `kept` most alike are named.
    """
    each = sets.select("set_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).alias("m")) for i, m in enumerate(_MINS[:runs])])).alias("e"))
    each = written(each.select("set_id", "e.*"), "runs")
    shared = each.groupBy("i", "m").agg(F.count("*").alias("n")).filter("n > 1")
    each = each.join(shared, ["i", "m"])
    central = each.groupBy("set_id").agg(F.sum("n").alias("central"))
    each = each.select("set_id", "i", "m")
    top = each.join(central, "set_id").groupBy("i", "m", F.pmod("set_id", F.lit(parts))).agg(F.max_by("set_id", "central").alias("leader"))
    top = top.select("i", "m", "leader")
    pairs = each.join(top, ["i", "m"]).filter("set_id <> leader").select(F.col("set_id").alias("a"), "leader").distinct()
    for side in ("a", "leader"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), _sketch().alias(f"sketch_{side}")), side)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sketch_a", "sketch_leader"))
            same = (x == y).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("leader"), pa.array(same)], ["a", "leader", "same"])

    pairs = pairs.select("a", "leader", "sketch_a", "sketch_leader").mapInArrow(count, "a long, leader long, same int").filter(F.col("same") >= equal)
    # a set has runs * parts leaders at most; whole sets are read for its most alike ones only
    best = F.slice(F.sort_array(F.collect_list(F.struct("same", "leader")), asc=False), 1, kept)
    return pairs.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.leader").alias("leader"))


def open_pairs(pairs: DataFrame, marks: DataFrame, a: str, b: str, percent: int, bounds: bool = False) -> DataFrame:
    """The pairs that the bitmaps of their two sets leave open, before whole sets are shuffled. With `bounds`, a pair of units stays
    if any two of their members may be similar (columns adds_* and least_*)."""
    for side, name in (("a", a), ("b", b)):
        pairs = pairs.join(marks.select(F.col("set_id").alias(name), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bits_{side}")), name)
    kept = [c for c in pairs.columns if c not in ("n_a", "n_b", "bits_a", "bits_b")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            column = pa.chunked_array([batch.column("bits_a"), batch.column("bits_b")]).combine_chunks()
            bits, words = bitmap_rows(column)
            i, j = np.arange(n), np.arange(n) + n
            both = most_common(size, bits, i, j, words)
            keep = both >= required(size[i], size[j], percent)
            if bounds:
                limits = zip(*(batch.column(c).to_pylist() for c in ("adds_a", "adds_b", "least_a", "least_b")), strict=True)
                for row, (adds_a, adds_b, least_a, least_b) in enumerate(limits):
                    if not keep[row] and (least_a or least_b):
                        keep[row] = within_bound(int(size[row]), int(size[n + row]), int(both[row]), (adds_a, least_a), (adds_b, least_b), percent)
            yield batch.select(kept).filter(pa.array(keep))

    return pairs.mapInArrow(check, pairs.select(*kept).schema)


def leader_answers(docs: DataFrame, sets: DataFrame, marks: DataFrame, k: int, percent: int, similar: int) -> DataFrame:
    """(a, leader, na, lacks, adds, alike) of the likely pairs that are similar. lacks and adds hold the tokens of the leader that a
    lacks, and those it adds; alike says that the pair is highly similar."""
    pairs = written(open_pairs(likely_pairs(sets), marks, "a", "leader", percent), "leaders")
    tokens = written(tokens_of(docs, sets, pairs.select(F.col("a").alias("set_id")).union(pairs.select("leader")), k), "tokens")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, leader, ta, tb in zip(*(batch.column(c) for c in ("a", "leader", "ta", "tb")), strict=True):
                a, leader, x, y = a.as_py(), leader.as_py(), _set(ta.as_buffer()), _set(tb.as_buffer())
                in_y, in_x = _hits(x, y), _hits(y, x)
                both, union = int(in_y.sum()), len(x) + len(y) - int(in_y.sum())
                if 100 * both >= percent * union:
                    rows.append((a, leader, len(x), y[~in_x].tobytes(), x[~in_y].tobytes(), 100 * both >= similar * union))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "leader", "na", "lacks", "adds", "alike"])

    return written(_both(pairs, tokens, "a", "leader").mapInArrow(answer, "a long, leader long, na long, lacks binary, adds binary, alike boolean"), "answers")


def within_bound(na: int, nb: int, both: int, a: tuple[int | None, int | None], b: tuple[int | None, int | None], percent: int) -> bool:
    """Whether any two sets of two units may be similar, when their leaders share `both` tokens at most. a and b: the most tokens
    that a member adds to the leader and the least size of a member; None without members."""
    least = required(min(na, a[1] or na), min(nb, b[1] or nb), percent)
    return both + (a[0] or 0) + (b[0] or 0) >= least


def unit_links(docs: DataFrame, sets: DataFrame, marks: DataFrame, pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The unit pairs between which at least one pair of sets is similar, answered through the leaders."""
    stats = members.groupBy("unit").agg(F.max(F.length("adds") / 8).cast("long").alias("adds"), F.min("na").alias("least"), F.count("*").alias("members"))
    bounded = pairs
    for side in "ab":
        bounded = bounded.join(stats.select(F.col("unit").alias(f"u{side}"), F.col("adds").alias(f"adds_{side}"), F.col("least").alias(f"least_{side}")), f"u{side}", "left")
    bounded = written(open_pairs(bounded, marks, "ua", "ub", percent, bounds=True), "open_units")
    tokens = written(tokens_of(docs, sets, bounded.select(F.col("ua").alias("set_id")).union(bounded.select("ub")), k), "tokens")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ua", "ub", "ta", "tb", "adds_a", "adds_b", "least_a", "least_b")
        for batch in batches:
            rows = []
            sets_of = (batch.column(c) for c in ("ta", "tb"))
            for ua, ub, ta, tb, adds_a, adds_b, least_a, least_b in zip(*(batch.column(c).to_pylist() for c in names[:2]), *sets_of, *(batch.column(c).to_pylist() for c in names[4:]), strict=True):
                x, y = _set(ta.as_buffer()), _set(tb.as_buffer())
                both = int(_hits(x, y).sum())
                linked = both >= required(len(x), len(y), percent)
                if linked or ((least_a or least_b) and within_bound(len(x), len(y), both, (adds_a, least_a), (adds_b, least_b), percent)):
                    rows.append((ua, ub, linked))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["ua", "ub", "linked"])

    answered = written(_both(bounded, tokens, "ua", "ub").mapInArrow(answer, "ua long, ub long, linked boolean"), "unit_answers")
    undecided = answered.filter("not linked").select("ua", "ub")
    chunk = F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / MEMBERS))
    grouped = members.join(stats.select("unit", "members"), "unit").groupBy("unit", chunk.alias("chunk")).agg(F.collect_list(F.struct("lacks", "adds")).alias("list"))
    rows = _both(undecided, tokens, "ua", "ub")
    for side in "ab":
        rows = rows.join(grouped.select(F.col("unit").alias(f"u{side}"), F.col("list").alias(f"list_{side}")), f"u{side}", "left")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield linked_units(batch, percent)

    derived = rows.select("ua", "ub", "ta", "tb", "list_a", "list_b").mapInArrow(derive, "ua long, ub long")
    return answered.filter("linked").select("ua", "ub").union(derived)


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, component) after the links (a, b): the components that a link connects become one, and only they are walked."""
    for side in "ab":
        links = links.join(parts.select(F.col("set_id").alias(side), F.col("component").alias(f"of_{side}")), side)
    merged = connected_components(links, "of_a", "of_b").toDF("component", "into")
    return written(parts.join(merged, "component", "left").select("set_id", F.coalesce("into", "component").alias("component")), "parts")


def linked_units(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The rows (ua, ub) of a batch that link. Sets are read where they are, and the members of one row at a time become Python values."""
    keep = np.zeros(batch.num_rows, bool)
    for row, (ta, tb, list_a, list_b) in enumerate(zip(*(batch.column(c) for c in ("ta", "tb", "list_a", "list_b")), strict=True)):
        keep[row] = _any_link(ta.as_buffer(), tb.as_buffer(), list_a.as_py(), list_b.as_py(), percent)
    return batch.select(["ua", "ub"]).filter(pa.array(keep))


def _any_link(ta: bytes | pa.Buffer, tb: bytes | pa.Buffer, list_a: list[dict] | None, list_b: list[dict] | None, percent: int) -> bool:
    """Whether a member of one unit is similar to one of the other. Overlaps with the other leader follow from the
    leaders' overlap and the few tokens a member lacks and adds; full sets are built only within the bound."""
    x, y = _set(ta), _set(tb)
    both = int(_hits(x, y).sum())
    empty = {"lacks": b"", "adds": b""}
    left = []
    for m in [empty, *(list_a or [])]:
        lacks, adds = _set(m["lacks"]), _set(m["adds"])
        left.append((len(x) - len(lacks) + len(adds), both - int(_hits(lacks, y).sum()) + int(_hits(adds, y).sum()), lacks, adds))
    for m in [empty, *(list_b or [])]:
        lacks, adds = _set(m["lacks"]), _set(m["adds"])
        size = len(y) - len(lacks) + len(adds)
        other = None
        for n, overlap, gone, new in left:
            need = required(n, size, percent)
            if overlap + len(adds) < need:
                continue
            if other is None:
                other = np.union1d(y[~_hits(y, lacks)], adds)
            if int(_hits(np.union1d(x[~_hits(x, gone)], new), other).sum()) >= need:
                return True
    return False


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, similar: int = 90) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles; one with
    fewer words has the whole sequence as its one shingle. A null, empty or blank text has an empty set and
    links with nothing. A row without doc_id links with nothing and has no component. Repeated rows come
    back as often as they occur; other columns are left behind; an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):  # all Python work is done inside; what is returned reads written tables only
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent, similar)


def _components(docs: DataFrame, k: int, percent: int, similar: int) -> DataFrame:
    signed = written(signatures(docs, k), "signatures")
    named = signed.filter("doc_id is not null and set_id is not null")
    sets = written(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), *[F.min(m).alias(m) for m in _MINS]), "sets")
    marks = named.join(sets.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"]).select("set_id", "n", "bitmap")
    marks = written(marks.dropDuplicates(["set_id"]), "marks")
    answers = leader_answers(docs, sets, marks, k, percent, similar)
    alike = answers.filter("alike and leader < a")
    members = alike.join(alike.select(F.col("a").alias("leader")), "leader", "left_anti").groupBy("a").agg(F.min("leader").alias("unit"))
    members = written(members.join(alike, (members.a == alike.a) & (members.unit == alike.leader)).select(members.a, "unit", "na", "lacks", "adds"), "members")
    entries = written(shared_lists(prefixes(docs, k, percent, common_tokens(signed))), "lists")
    parts = joined(sets.select("set_id", F.col("set_id").alias("component")), answers.select("a", F.col("leader").alias("b")))
    units = members.select(F.col("a").alias("set_id"), "unit")
    for best in (LIKELY, None):  # what the likeliest pairs connect leaves no pairs to answer
        pairs = written(candidate_units(entries, parts.join(units, "set_id", "left"), marks, percent, best), "unit_pairs")
        parts = joined(parts, unit_links(docs, sets, marks, pairs, members, k, percent).toDF("a", "b"))
    placed = sets.select("set_id", "rep").join(parts, "set_id")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = placed.join(least, "component").select("set_id", "component_id")
    rows = signed.filter("token is null").select("doc_id", "set_id", F.col("n").alias("n_shingles"))
    return rows.join(found, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
