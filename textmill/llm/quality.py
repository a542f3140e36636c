"""Operator 9: quality classifier. Logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text: hashes of its words, of neighbouring word pairs, and of the same n-grams over
word shapes (runs of one class of character in place of the characters), each cut to `bits` bits.
A text's values are its feature counts over the root of their squared sum, so long and short texts
weigh alike. Training is one bounded task: at most FIT_ROWS labelled rows of at most FIT_TEXT bytes each, those
with the least hashed ids, in the order of another hash and up to FIT_BYTES in all, a fixed number of passes. Scoring reads every row once,
without a shuffle; the weights are one array of 2**bits floats, whatever the data's size.

Null or empty text: only the bias speaks. Repeated rows are scored one by one; a repeated label
counts once (the lower), a null one not at all. Without labels every score is 0.5. Empty tables
give no rows. Only the text is a feature, so clashing or extra columns never enter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.words import U, Words, chunks, mix, span_hashes, windows

#: Bounds on the labelled rows that the weights are fitted on: rows, bytes of one text, bytes of all texts.
FIT_ROWS, FIT_TEXT, FIT_BYTES = 20_000, 128 << 10, 64 << 20
BITS = 20
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 4
_KIND[97:123] = 1
_KIND[128:] = 1
for _c in b"!#$%&*|<>":
    _KIND[_c] = _c


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: its classes of bytes with repeats dropped."""
    kind = _KIND[words.bytes]
    new = np.zeros(len(kind) + 1, dtype=bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[words.starts] = True
    inside = np.zeros(len(kind) + 1, dtype=np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    new[:-1] &= np.cumsum(inside[:-1]) > 0
    rank = np.concatenate([[0], np.cumsum(new)])
    return span_hashes(kind[new[:-1]], rank[words.starts], rank[words.ends]) ^ U(0x5A5A5A5A)


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams, text by text, and the n+1 offsets of the texts."""
    w = Words(column)
    h, n = w.hash, len(w.counts)
    s = shapes(w)
    found, owner = [h, s], [w.text_of, w.text_of]
    for x, salt in ((h, 1), (s, 2)):
        at, pair = windows(x, w.first, 2)
        found.append(pair + U(salt))
        owner.append(np.searchsorted(w.first, at, side="right") - 1)
    numbers = (mix(np.concatenate(found)) >> U(64 - bits)).astype(np.int64)
    text = np.concatenate(owner)
    order = np.argsort(text, kind="stable")
    return numbers[order], np.searchsorted(text[order], np.arange(n + 1))


def _sparse(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(numbers, return_counts=True)
    value = np.log1p(count)
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 terms; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        at, value = np.append(at, 1 << self.bits), np.append(value, 1.0)
        w = self.weights(at)
        g = (_sigmoid(w @ value) - label) * value
        more = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (more - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(sample: DataFrame, passes: int = 4, bits: int = BITS) -> np.ndarray:
    """Weights from a bounded table of (t text, y 0/1), in one task."""

    def run(batches):
        rows, labels, left = [], [], FIT_BYTES
        for part in chunks(batches, "t", min(2 << 20, FIT_BYTES)):
            if left <= 0:
                break
            left -= part.column("t").nbytes
            numbers, offs = features(part.column("t"), bits)
            rows += [_sparse(numbers[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
            labels += part.column("y").to_pylist()
        model = Ftrl(bits)
        for _ in range(passes):
            for (at, value), y in zip(rows, labels, strict=True):
                model.learn(at, value, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["w"])

    got = sample.select("t", F.col("y").cast("double").alias("y"), F.xxhash64("id", F.lit("order")).alias("o"), "id").orderBy("o", "id", "t").coalesce(1).select("t", "y").mapInArrow(run, "w binary").collect()
    return np.frombuffer(got[0].w, dtype=np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    marked = labels.select(F.col("doc_id").alias("id"), F.col(f"`{label}`").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most `rows` rows of two numbers: its size is bounded by the parameter
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(marked), "id").where(F.octet_length("t") <= FIT_TEXT)
    return train(texts.orderBy(F.xxhash64("id"), "id", "t").limit(rows))


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key and score, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        w = held.value
        for part in chunks(batches, "t", 1 << 20):
            numbers, offs = features(part.column("t"), bits)
            n = len(offs) - 1
            pairs = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(offs)) | numbers
            each, count = np.unique(pairs, return_counts=True)
            text, value = each >> bits, np.log1p(count)
            dots = np.bincount(text, w[each & ((1 << bits) - 1)] * value, n)
            norm = np.sqrt(np.bincount(text, value * value, n))
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(_sigmoid(dots / np.maximum(norm, 1e-12) + w[-1]))], [key, "score"])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"`{key}` {kind}, score double")
