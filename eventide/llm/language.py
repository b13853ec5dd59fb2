"""Language identification by nearest centroid.

Method: a text is a normalised TF-IDF vector of hashed character n-grams; each language has several centroids from
spherical k-means; a text takes the language of the centroid with the largest cosine, and is rejected when that
cosine is below the distance that the language's own texts keep. Document frequencies are counted over
all texts with a language outside fold 0; only the centroids are fitted on a bounded sample per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import SAMPLE_CHARS, fold

BUCKETS = 1 << 12
_SHIFT = np.uint64(64 - 12)
#: Letters keep their lower case; every other ASCII byte is a space.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def counts(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, documents x BUCKETS) of the 2- and 3-gram counts of at most `rows` texts at a time."""
    for first, end, data, offsets in tk.chunks(column):
        for a in range(0, end - first, rows):
            b = min(a + rows, end - first)
            own = offsets[a : b + 1] - offsets[a]
            # every text stands between two spaces of its own
            text = np.full(len(data[offsets[a] : offsets[b]]) + 2 * (b - a), 0x20, np.uint8)
            doc = np.repeat(np.arange(b - a), np.diff(own) + 2)
            text[np.arange(own[-1]) + 2 * np.repeat(np.arange(b - a), np.diff(own)) + 1] = _LETTERS[data[offsets[a] : offsets[b]]]
            wide = text.astype(np.uint64)
            pairs = (wide[:-1] << np.uint64(8)) | wide[1:]
            triples = (pairs[:-1] << np.uint64(8)) | wide[2:] | np.uint64(1 << 24)
            out = np.zeros((b - a) * BUCKETS, np.int64)
            for grams, n in ((pairs, 2), (triples, 3)):
                inside = doc[n - 1 :] == doc[: len(grams)]
                bucket = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int64)
                out += np.bincount((doc[: len(grams)] * BUCKETS + bucket)[inside], minlength=len(out))
            yield first + a, out.reshape(b - a, BUCKETS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = count.astype(np.float32) * idf.astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


@dataclass(frozen=True)
class Centroids:
    """Languages in sorted order, their centroids, the language of each, and the least cosine of each language."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    of: np.ndarray
    floor: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, its share of a sharpened softmax over the languages' best cosines, rejected)."""
        if not self.languages:
            return np.full(len(x), -1), np.zeros(len(x)), np.ones(len(x), bool)
        cosine = x @ self.centres.T
        best = np.stack([cosine[:, self.of == i].max(axis=1) for i in range(len(self.languages))], axis=1)
        pick = best.argmax(axis=1)
        top = best[np.arange(len(x)), pick]
        share = 1 / np.exp((best - top[:, None]) * 20).sum(axis=1)
        return pick, share, top < self.floor[pick]


def spherical_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centres of unit vectors by cosine; an empty cluster takes the vector that fits worst."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cosine = x @ centres.T
        own = cosine.argmax(axis=1)
        centres = np.stack([x[own == c].sum(axis=0) if (own == c).any() else x[cosine.max(axis=1).argmin()] for c in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are; BUCKETS + 1 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, found in counts(batch.column(0)):
                total[:-1] += (found > 0).sum(axis=0)
                total[-1] += len(found)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[rows["bucket"]] = rows["n"]
    return total[:-1], int(total[-1])


def train(docs: DataFrame, per_language: int = 800, centres: int = 4, seed: int = 11, slack: float = 0.5) -> Centroids:
    """Inverse document frequencies over all learnable texts; centroids from at most `per_language` texts a language,
    drawn by a hash. A language's floor is `slack` times the lowest of 99 % of its sample's cosines."""
    rows = learnable(docs)
    df, n = document_frequencies(rows)
    idf = np.log((n + 1) / (df + 1)) + 1
    sample = _sample(rows, per_language).toArrow()
    if not sample.num_rows:
        return Centroids([], idf, np.zeros((0, BUCKETS)), np.zeros(0, int), np.zeros(0))
    x = np.concatenate([vectors(c, idf) for _, c in counts(sample.column("text").combine_chunks())])
    lang = np.array(sample.column("lang").to_pylist())
    languages = sorted(set(lang))
    each = [spherical_means(x[lang == name], centres, seed) for name in languages]
    floor = [slack * np.quantile((x[lang == name] @ c.T).max(axis=1), 0.01) for name, c in zip(languages, each, strict=True)]
    return Centroids(languages, idf, np.concatenate(each), np.repeat(np.arange(len(each)), [len(c) for c in each]), np.array(floor))


def _sample(rows: DataFrame, per_language: int, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, lang, text): at most `per_language` rows a language with different ids or texts, by a hash of both.

    A language's count of rows gives the share of hashes that holds twice as many as are wanted; only those are ranked, so no
    task ranks a language. Repeated rows are one. Texts of more than `most_chars` characters are not taken.
    """
    short = rows.filter(F.length("text") <= most_chars).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text", F.lit(9)).alias("draw"))
    counted = {r["lang"]: r["n"] for r in short.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(None).cast("double")
    for lang, n in counted.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2.0 * per_language / n)).otherwise(share)
    near = short.filter(F.pmod("draw", F.lit(1 << 40)) < share * float(1 << 40)).dropDuplicates(["lang", "doc_id", "draw"])
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
    return ranked.filter(F.col("rn") <= per_language).orderBy("lang", "doc_id", "draw").select("doc_id", "lang", "text")


def predictions(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every whole text.

    lang_pred is `und`, with score 0, where the text is null or has no letter (and where nothing was learned); else the
    language of the nearest centroid, with rejected set where even that one is too far. Only the text is an input. Repeated rows are kept, other
    columns left behind; an empty table gives an empty one.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, "und"]
        for batch in batches:
            text = batch.column(1)
            letters = has_letter(text)
            for first, found in counts(text):
                n = len(found)
                pick, share, far = model.nearest(vectors(found, model.idf))
                known = letters[first : first + n] & (pick >= 0)
                lang = np.where(known, pick, len(names) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array([names[i] for i in lang]), pa.array(np.where(known, share, 0.0).astype(np.float64)), pa.array(far | ~known)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return rated.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; ASCII letters are found on the bytes, others by character."""
    out = np.zeros(len(column), bool)
    for first, end, data, offsets in tk.chunks(column):
        sums = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
        out[first:end] = sums[offsets[1:]] > sums[offsets[:-1]]
        beyond = np.concatenate(([0], np.cumsum(data >= 0x80)))
        for i in np.flatnonzero(~out[first:end] & (beyond[offsets[1:]] > beyond[offsets[:-1]])):
            out[first + i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out
