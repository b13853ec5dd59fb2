"""Packing of tokenised documents into fixed-length sequences.

Method: first-fit decreasing with a tournament tree over bin capacities, run independently inside
randomised groups of documents. Documents are tokenised once in a narrow pass; what is packed afterwards is
one small row per piece. A document is cut at multiples of the sequence length, so only its last piece
needs a place; groups hold about `group_size` pieces however large the corpus is, drawn by a hash of the
document, so copies and long documents spread evenly.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.tables import written

#: The id that ends every document.
END = 1
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 400_000
_PLAIN = re.compile(rb"[a-z]+([,.]?)")
_LATIN = re.compile("[a-zß-öø-ÿ]+([,.]?)")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of whole texts, found word by word: the vocabulary's rules never join across white space, so the
    ids of a text are those of its words in order, and a word's ids are looked up once while it is kept.

    Lower-case Latin words (with a comma or full stop after them at most) go straight to the merge model;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.ends = {p: self._bytes(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids) for p in (b"", b",", b".")}
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        if m := _PLAIN.fullmatch(word):
            body, end = word[: m.start(1)].decode(), m[1]
        elif m := _LATIN.fullmatch(text := word.decode()):
            body, end = text[: m.start(1)].translate(self.letters), m[1].encode()
        else:
            return self._bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return self._bytes([t.id for t in self.model.tokenize(body)]) + self.ends[end]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        split = text.encode().lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in split])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in split:
            if w not in known:
                known[w] = self._new(w)
        return b"".join([known[w] for w in split])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048) -> DataFrame:
    """One row per piece of each document: start, length, crc32 of its ids, ids of its document.

    Null text is empty text; an empty document is its end id alone. A null doc_id is kept. Other columns
    are left behind, so clashing names cannot meet.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer_path), np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + last
                total = len(ids) // 4
                for at in range(0, total, length):
                    piece = memoryview(ids)[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class Tournament:
    """Winner tree over bins in order of opening: each node holds the largest room below it, so the first
    bin with enough room is found, and updated, in a walk of the tree's height."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room left in it before) of the first bin that takes `size`."""
        room, at = self.room, 1
        while at < self.leaves:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        spot, left = at - self.leaves, room[at]
        room[at] -= size
        while at := at >> 1:
            room[at] = max(room[2 * at], room[2 * at + 1])
        return spot, left


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; larger items go first, ties in the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(len(sizes), room)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], left = tree.place(int(sizes[i]))
        offsets[i] = room - left
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, group_size: int = 8192) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed at.

    Every id lies in exactly one piece; a sequence is filled gapless from offset 0 and is padded at its end.
    group_size is the mean number of pieces packed together; the number of groups follows the input, so
    a sequence is unfilled once per group at most, besides what first-fit leaves. Repeated rows are packed
    as often as they occur; an empty table gives an empty table.
    """
    pieces = written(tokenised_pieces(docs, tokenizer_path, length), "pieces")
    groups = max(1, round(pieces.count() / group_size))
    # drawn per written row, so that neither a hot id nor a repeated row makes a group grow
    row = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(17))
    keyed = pieces.withColumn("pack_group", F.pmod(row, F.lit(groups)))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        out = group.drop(columns="pack_group")
        return out.assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    return keyed.groupBy("pack_group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
