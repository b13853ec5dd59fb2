"""Toxicity scores from subword-bag embeddings.

Method: every word is a bag of its character n-grams and itself; the bag's embeddings are averaged and go through a
linear softmax, and embeddings and softmax are trained jointly in numpy. Words that were never seen share
n-gram vectors with those that were. A document's score is that of its most toxic word, so a word counts the same in a
short text and in a very long one; training follows the same rule (the gradient of a document goes to its
highest words). The softmax is linear in the average, so a trained model is one number per bucket: scoring is a lookup per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk
from eventide.llm.tables import SAMPLE_CHARS, fold, rows_with

NGRAMS = range(3, 7)
#: Bytes of text that are scored at once; each has several n-grams, so the work arrays are much larger.
TEXT = 1 << 18


@dataclass(frozen=True)
class SubwordModel:
    """weights: the toxic log-odds that each bucket's embedding adds when averaged; bias: theirs without words."""

    weights: np.ndarray
    bias: float


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, one start and end per distinct word, index of each word's distinct word, its document)."""
    lowered = tk.LOWER[data]
    starts, ends, doc = tk.words(lowered, offsets, tk.WORD)
    if not len(starts):
        return lowered, starts, ends, doc
    hashes = tk.span_hashes(tk.prefix_hashes(lowered), starts, ends)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return lowered, np.stack([starts[first], ends[first]]), inverse, doc


def subwords(lowered: np.ndarray, spans: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of <word> and of the word itself, for spans of a byte array."""
    starts, ends = spans
    size = ends - starts + 2
    at = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(word)) - at[word]
    text = np.full(len(word), ord("<"), np.uint8)
    body = (inner > 0) & (inner < size[word] - 1)
    text[body] = lowered[(starts[word] + inner - 1)[body]]
    text[at + size - 1] = ord(">")
    sums = tk.prefix_hashes(text)
    found = [tk.span_hashes(sums, at, at + size)]
    of = [np.arange(len(size))]
    for n in NGRAMS:
        here = np.flatnonzero(inner + n <= size[word])
        found.append(tk.span_hashes(sums, here, here + n))
        of.append(word[here])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int32), np.concatenate(of).astype(np.int32)


def _means(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n) / np.maximum(np.bincount(of, minlength=n), 1)


def fit(texts: pa.Array, toxic: np.ndarray, buckets: int = 1 << 18, dim: int = 8, epochs: int = 25, rate: float = 0.5, seed: int = 3) -> SubwordModel:
    """Joint training on whole documents by full-batch AdaGrad.

    In the first epoch a toxic document's words are ranked by the smoothed log-odds of their buckets, afterwards by
    the model. A toxic document teaches with its highest word, a clean one with its four highest, and each class has
    the same total weight.
    """
    rng = np.random.default_rng(seed)
    docs, pairs_doc, pairs_word, bucket, per_word = 0, [], [], [], []
    known = np.zeros(0, np.uint64)  # distinct words so far, in order of first sight
    for first, end, data, offsets in tk.chunks(texts):
        lowered, spans, inverse, doc = distinct_words(data, offsets)
        if len(doc):
            own = tk.span_hashes(tk.prefix_hashes(lowered), spans[0], spans[1])
            both = np.unique(np.stack([doc.astype(np.int64) + first, inverse]), axis=1)
            pairs_doc.append(both[0].astype(np.int32))
            pairs_word.append(own[both[1]])
            new = ~np.isin(own, known)
            b, w = subwords(lowered, spans[:, new], buckets)
            bucket.append(b[np.argsort(w, kind="stable")])
            per_word.append(np.bincount(w, minlength=int(new.sum())))
            known = np.concatenate([known, own[new]])
        docs = end
    if not docs or not len(known) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return SubwordModel(np.zeros(buckets), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    bucket, per_word = np.concatenate(bucket), np.concatenate(per_word)
    word_at = np.cumsum(per_word) - per_word
    sorter = np.argsort(known)
    doc = np.concatenate(pairs_doc)
    word = sorter[np.searchsorted(known, np.concatenate(pairs_word), sorter=sorter)].astype(np.int32)
    del sorter, pairs_doc, pairs_word
    n_toxic = int(toxic.sum())

    def averages(weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights.astype(np.float32)[bucket], word_at) / per_word

    # document frequencies of words and, through them, of buckets
    odds = np.zeros(buckets)
    for c, n, sign in ((1, n_toxic, 1), (0, len(toxic) - n_toxic, -1)):
        seen = np.bincount(word[toxic[doc] == c], minlength=len(known))
        total = np.zeros(buckets)
        for at in range(0, len(known), 1 << 15):  # a slice of the words at a time
            size = per_word[at : at + (1 << 15)]
            total += np.bincount(bucket[word_at[at] : word_at[at] + size.sum()], np.repeat(seen[at : at + len(size)], size), buckets)
        odds += sign * np.log((total + 1) / (n + 1))
    rank = averages(odds)

    emb = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    out = rng.uniform(-1, 1, dim).astype(np.float32)
    bias, g_emb, g_out, g_bias = 0.0, np.full(buckets, 1e-8, np.float32), np.full(dim, 1e-8, np.float32), 1e-8
    for epoch in range(epochs):
        order = np.lexsort((-rank[word], doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        used = order[place < np.where(toxic[doc[order]] == 1, 1, 4)]
        label, w = toxic[doc[used]].astype(float), word[used]
        size = per_word[w]
        take = np.repeat(word_at[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        feature, example = bucket[take], np.repeat(np.arange(len(w)), size)
        mean = np.stack([np.bincount(example, emb[feature, d], len(w)) for d in range(dim)], axis=1) / size[:, None]
        error = 1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30))) - label
        error *= np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum()) * 100
        # gradients of the softmax and of the averaged embeddings
        d_out, d_bias = error @ mean, error.sum()
        push = np.bincount(feature, (error / size)[example], buckets)
        g_emb += (push**2 * (out @ out)).astype(np.float32)
        g_out, g_bias = g_out + d_out**2, g_bias + d_bias**2
        emb -= (rate * push / np.sqrt(g_emb))[:, None].astype(np.float32) * out
        out = (out - rate * d_out / np.sqrt(g_out)).astype(np.float32)
        bias -= rate * d_bias / np.sqrt(g_bias)
        weights = (emb @ out).astype(np.float64)
        rank = averages(weights)
    # the cut between the classes' highest words, at their true shares, moves to 1/2
    top = np.full(docs, -np.inf)
    np.maximum.at(top, doc, rank[word])
    return SubwordModel(weights, -_cut(top, toxic))


def _cut(top: np.ndarray, toxic: np.ndarray) -> float:
    """The value that separates the classes with the fewest errors; the middle of the widest such gap."""
    top = np.maximum(top, -1e3)
    order = np.argsort(top)
    t, y = top[order], toxic[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    edges = np.concatenate(([t[0] - 1], t, [t[-1] + 1]))
    gaps = np.diff(edges)
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(gaps[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def word_scores(model: SubwordModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, document) of every word of a chunk."""
    lowered, spans, inverse, doc = distinct_words(data, offsets)
    if not len(doc):
        return np.zeros(0), doc
    bucket, of = subwords(lowered, spans, len(model.weights))
    return (_means(model.weights[bucket], of, spans.shape[1]) + model.bias)[inverse], doc


def training_rows(docs: DataFrame, labels: DataFrame, column: str, positives: int, negatives: int, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label): a bounded sample of labelled documents outside fold 0, in the order of the id.

    Ids are drawn by a hash. Of rows that share an id one is taken, by a hash of the text; texts of more than `most_chars`
    characters are not learned from. So rows and bytes are bounded, however often an id occurs and however long texts are.
    """
    marked = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    marked = marked.groupBy("doc_id").agg(F.max(column).alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(5)))
    picked = [marked.filter(F.col("label") == c).orderBy("draw", "doc_id").limit(n) for c, n in ((1, positives), (0, negatives))]
    # the bound on the sample is the bound on what is broadcast
    sample = F.broadcast(picked[0].union(picked[1]).select(F.col("doc_id").alias("label_doc"), "label"))
    short = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    rows = short.join(sample, F.col("doc_id") == F.col("label_doc"))
    one = rows.groupBy("label_doc", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.orderBy("label_doc").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3000) -> SubwordModel:
    """Fit on at most `positives` + `negatives` labelled documents, on the driver."""
    rows = training_rows(docs, labels, "toxic", positives, negatives).toArrow()
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64))


def text_scores(model: SubwordModel, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) of the chunks of a column of texts."""
    for first, end, data, offsets in tk.chunks(texts, TEXT):
        odds, doc = word_scores(model, data, offsets)
        best = np.full(end - first, -np.inf)
        if len(doc):
            at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            best[doc[at]] = np.maximum.reduceat(odds, at)
        with np.errstate(over="ignore"):
            yield first, 1 / (1 + np.exp(-best))


def scores(docs: DataFrame, model: SubwordModel, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null or empty text, or one without a word, scores 0. Only the text is an input. A null doc_id gives a null held_out. Repeated rows are
    kept, other columns left behind, and an empty table gives an empty one.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, value in text_scores(model, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(value)), pa.array(value)], ["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return rated.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: SubwordModel, cut: float = 0.5) -> DataFrame:
    """The rows of docs that `scores` does not predict toxic, with their columns."""
    return rows_with(docs, lambda texts: ((first, value < cut) for first, value in text_scores(model, texts)))
