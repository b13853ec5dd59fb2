"""Document quality by regularised quadratic discriminant analysis.

Method: statistics of the text are transformed towards normal shape; each class has a mean and a covariance shrunk
towards the pooled diagonal; a score is the posterior from the difference of two Mahalanobis log-densities, computed
with Cholesky factors that are cached in the model. The text is read once: its statistics are written as one
small row per document, from which the moments of all labelled rows and all scores come. No row is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import fold, rows_with, written

FEATURES = (
    "words", "word_length", "word_length_spread", "distinct_words", "top_word", "distinct_pairs", "repeated_next", "distinct_lines",
    "line_words", "punctuation", "symbols", "digits", "upper", "beyond_ascii", "white", "byte_entropy", "ends",
)
#: Bytes of text whose statistics are taken at once.
TEXT = 1 << 18
_PUNCT, _SYMBOL, _DIGIT, _UPPER, _END, _LINE = (np.zeros(256, bool) for _ in range(6))
_PUNCT[[*b"!\"'(),-.:;?"]] = True
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_END[[*b".!?"]] = True
_LINE[:] = True
_LINE[0x0A] = False


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and uses of the most used one, per document."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))) if len(v) else np.zeros(0, np.int64)
    uses = np.diff(np.append(at, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], uses)
    return np.bincount(d[at], minlength=n).astype(float), most


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, documents x FEATURES) per chunk; counts as logs, shares as smoothed log-odds."""
    for first, end, data, offsets in tk.chunks(column, TEXT):
        n = end - first
        size = np.diff(offsets).astype(float)
        starts, ends, doc = tk.words(data, offsets, tk.NOT_WHITE)
        length = (ends - starts).astype(float)
        words = np.bincount(doc, minlength=n).astype(float)
        some = np.maximum(words, 1)
        mean = np.bincount(doc, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0))
        sums = tk.prefix_hashes(data)
        hashes = tk.span_hashes(sums, starts, ends)
        distinct, top = _distinct(hashes, doc, n)
        same = doc[1:] == doc[:-1]
        pairs = tk.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
        pair_doc = doc[:-1][same]
        n_pairs = np.bincount(pair_doc, minlength=n).astype(float)
        distinct_pairs, _ = _distinct(pairs, pair_doc, n)
        again = np.bincount(pair_doc, hashes[:-1][same] == hashes[1:][same], n)
        l_starts, l_ends, l_doc = tk.words(data, offsets, _LINE)
        lines = np.bincount(l_doc, minlength=n).astype(float)
        distinct_lines, _ = _distinct(tk.span_hashes(sums, l_starts, l_ends), l_doc, n)
        share = {name: _per_doc(kind[data], offsets) for name, kind in (("punct", _PUNCT), ("symbol", _SYMBOL), ("digit", _DIGIT), ("upper", _UPPER), ("white", tk.WHITE), ("end", _END))}
        beyond = _per_doc(data >= 0x80, offsets)
        entropy = np.zeros(n)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        for at in range(0, n, 1024):
            a, b = offsets[at], offsets[min(at + 1024, n)]
            count = np.bincount((owner[a:b] - at) * 256 + data[a:b], minlength=256 * min(1024, n - at)).reshape(-1, 256)
            p = count / np.maximum(count.sum(axis=1, keepdims=True), 1)
            entropy[at : at + len(p)] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        yield first, np.stack(
            [
                np.log1p(words), np.log1p(mean), np.log1p(spread), _logit(distinct, words), _logit(top, words), _logit(distinct_pairs, n_pairs),
                _logit(again, n_pairs), _logit(distinct_lines, lines), np.log1p(words / np.maximum(lines, 1)), _logit(share["punct"], size),
                _logit(share["symbol"], size), _logit(share["digit"], size), _logit(share["upper"], size), _logit(beyond, size),
                _logit(share["white"], size), entropy, np.log1p(words / np.maximum(share["end"], 1)),
            ],
            axis=1,
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; null text counts as empty."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in statistics(batch.column(1)):
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), values], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log-density constant with the prior."""

    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        each = [self.constant[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return each[1] - each[0]


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float) -> Discriminant:
    """From the counts, sums and sums of products of the two classes. A class without rows takes the other's shape."""
    d = sums.shape[1]
    total = max(n.sum(), 1)
    overall = sums.sum(axis=0) / total
    pooled = np.maximum(np.diag(products.sum(axis=0)) / total - overall**2, 0) + 1e-4
    means, whiten, constant = [], [], []
    for c in (0, 1):
        mean = sums[c] / n[c] if n[c] else overall
        cov = products[c] / n[c] - np.outer(mean, mean) if n[c] else np.diag(pooled)
        weight = (shrink * n[c] + d) / (n[c] + d)  # few rows: closer to the pooled diagonal
        factor = np.linalg.cholesky((1 - weight) * cov + weight * np.diag(pooled))
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log((n[c] + 1) / (total + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(constant))


def train(stats: DataFrame, labels: DataFrame, column: str = "quality", shrink: float = 0.02) -> Discriminant:
    """Moments of all labelled documents outside fold 0, combined on the executors; 2 x d x d numbers reach the driver."""
    d = len(FEATURES)
    marked = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    marked = marked.groupBy(F.col("doc_id").alias("label_doc")).agg(F.min(column).alias("label"))
    rows = stats.join(marked, F.col("doc_id") == F.col("label_doc")).select("label", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for c in (0, 1):
                total[c] += x[label == c].T @ x[label == c]
        c, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (c, i, j, total[c, i, j]))], ["c", "i", "j", "value"])

    got = rows.mapInArrow(moments, "c long, i long, j long, value double").groupBy("c", "i", "j").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros((2, d + 1, d + 1))
    total[got["c"], got["i"], got["j"]] = got["value"]
    return discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:], shrink)


def scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; only the text is an input of a score.

    Null text is scored as empty text. A null doc_id gives a null held_out. Repeated rows are kept, other columns left
    behind; without labels the score is 1/2 everywhere; an empty table gives an empty one.
    """
    stats = written(document_statistics(docs), "statistics")
    model = train(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            value = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    rated = stats.mapInArrow(score, "doc_id long, score double")
    return rated.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs that `scores` accepts, with their columns. The texts are read twice: for the model, and row by row for the decision.
    The statistics are written in between, so that a task has one Python worker at a time."""
    model = train(written(document_statistics(docs), "statistics"), labels)

    def keep(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for first, x in statistics(texts):
            yield first, 1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500))) >= cut

    return rows_with(docs, keep)
