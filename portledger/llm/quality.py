"""Document quality by logistic regression on hashed word n-grams.

Words, runs of signs and a mark for shouted words are the tokens; single tokens and pairs of neighbours
are hashed into a fixed number of features, pairs of the same token into one of their own. Training
follows the regularised leader over a bounded sample of labelled documents; a score is the sparse dot
product of a document's features with the weights, through the logistic function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, doc_rows, held_out, slices

BITS = 18
#: Labelled documents to learn from at most.
TRAIN_DOCS = 5000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
#: Score from which a document counts as good.
GOOD = 0.7
#: Fixed features: the constant, and a token that follows itself.
CONSTANT, REPEATED = 0, 1
CACHE_WORDS = 300_000
TOKENS = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")


class Features:
    """Sparse features of texts; remembers the token hashes of words."""

    def __init__(self):
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.loud = self._hash("^")

    @staticmethod
    def _hash(token: str) -> int:
        return xxhash.xxh3_64_intdigest(token.encode()) >> 1

    def _tokens(self, word: bytes) -> tuple[int, ...]:
        out: list[int] = []
        for token in TOKENS.findall(word.decode("utf-8", "replace")):
            small = token.lower()
            out.append(self._hash(small))
            if len(token) > 1 and token != small and token == token.upper():
                out.append(self.loud)
        return tuple(out)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values; the values but the constant's have length one together."""
        words = text.split()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for word in set(words).difference(self.words):
            self.words[word] = self._tokens(word)
        tokens = np.fromiter(chain.from_iterable(map(self.words.__getitem__, words)), dtype=np.uint64)
        left, right = tokens[:-1], tokens[1:]
        mixed = (left * np.uint64(0x9E3779B97F4A7C15) ^ right) * np.uint64(0xD6E8FEB86659FD93)
        shift = np.uint64(64 - BITS)
        pairs = np.where(left == right, np.uint64(REPEATED), mixed >> shift)
        single = tokens * np.uint64(0xD6E8FEB86659FD93) >> shift
        numbers, counts = np.unique(np.concatenate([single, pairs]).astype(np.int32), return_counts=True)
        values = np.log1p(counts)
        keep = numbers != CONSTANT
        numbers, values = numbers[keep], values[keep]
        values /= np.sqrt(values @ values) if len(values) else 1
        return np.append(numbers, CONSTANT).astype(np.int32), np.append(values, 1).astype(np.float32)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = (1 / (1 + np.exp(-(w @ values))) - label) * values
        grown = self.n[at] + slope * slope
        self.z[at] += slope - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int) -> list[tuple[int, bytes, bytes, int]]:
    """Features of at most ``max_docs`` labelled documents, the first by a hash of their id."""
    known = doc_rows(labels, "doc_id", "quality").filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = doc_rows(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_docs labels

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            pairs = [features(text) for text in as_bytes(batch.column(1))]
            columns = [batch.column(0), pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([b.tobytes() for _, b in pairs], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "values", "label"])

    rows = sample.mapInArrow(task, "doc_id long, at binary, values binary, label int").limit(max_docs).toArrow()
    return sorted(zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights learnt from labelled rows that are not held out; zeros where there are none."""
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for _, a, v, y in training_rows(docs, labels, max_docs)]
    model, rng = FollowTheLeader(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row; only ``text`` is read, a null one counts as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            sums = np.array([float(weights[at] @ values) for at, values in map(features, as_bytes(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-sums)), pa.float64())], names=["doc_id", "score"])

    return doc_rows(docs, "doc_id", "text").mapInArrow(task, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels of held-out documents are never read; a null label or id is passed over, and of several labels
    the better one counts. Empty texts get the score of the constant alone, 0.5 where nothing was
    learnt. Repeated rows each get their score; an empty table gives no rows.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
