"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of UTF-8 bytes, all of it. Bytes are embedded; filters of
several widths slide over a window, the largest answer of each filter is kept, and a softmax over those
gives the window's languages. A document takes the mean of its windows by their bytes. The network is
trained in numpy on a bounded sample of labelled documents, from windows spread over the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portledger.llm.common import as_bytes, doc_rows, held_out, slices, with_fields

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents to learn from at most, and windows taken of each.
TRAIN_DOCS = 3000
TRAIN_WINDOWS = 2
EPOCHS = 4
#: Windows that go through the network at a time.
BATCH = 32
UNKNOWN = "und"

#: Bytes as the network sees them: capitals as small letters, digits as one, also in the second byte of
#: Latin capitals. Byte 0 is padding.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else 48 if 48 <= b <= 57 else b for b in range(256)
)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the bytes in each, and where each text's windows begin."""
    counts = np.array([max(1, -(-len(text) // WINDOW)) for text in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    cells = np.zeros(begin[-1] * WINDOW, dtype=np.uint8)
    used = np.full(begin[-1], WINDOW, dtype=np.float64)
    for i, text in enumerate(texts):
        at = begin[i] * WINDOW
        cells[at : at + len(text)] = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
        used[begin[i + 1] - 1] = max(1, len(text) - (counts[i] - 1) * WINDOW)
    return cells.reshape(-1, WINDOW), used, begin[:-1]


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        size = FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (max(WIDTHS) * EMBED, size)).astype(np.float32) * cls.mask()
        out = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
        return cls(languages, embed, filters, np.zeros(size, np.float32), out, np.zeros(len(languages), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        """A narrow filter is a wide one whose last taps stay zero."""
        taps = np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED
        return (taps < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def patches(self, cells: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(cells), WINDOW + max(WIDTHS) - 1), dtype=np.uint8)
        padded[:, :WINDOW] = cells
        flat = self.embed[padded].reshape(len(cells), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(view).reshape(len(cells) * WINDOW, -1)

    def pooled(self, cells: np.ndarray) -> np.ndarray:
        answers = (self.patches(cells) @ self.filters).reshape(len(cells), WINDOW, -1)
        while answers.shape[1] > 1:
            half = answers.shape[1] // 2
            answers = np.maximum(answers[:, :half], answers[:, half:])
        return np.maximum(answers[:, 0] + self.shift, 0)

    def probabilities(self, cells: np.ndarray) -> np.ndarray:
        parts = [softmax(self.pooled(cells[i : i + BATCH]) @ self.out + self.bias) for i in range(0, len(cells), BATCH)]
        return np.concatenate(parts)

    def train(self, cells: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross-entropy; a filter learns from the place that won the pooling."""
        rng, mask = np.random.default_rng(seed), self.mask()
        params = [self.embed, self.filters, self.shift, self.out, self.bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(cells))
            for begin in range(0, len(order), BATCH):
                rows = order[begin : begin + BATCH]
                patches = self.patches(cells[rows])
                answers = (patches @ self.filters).reshape(len(rows), WINDOW, -1)
                won = answers.argmax(1)
                best = np.take_along_axis(answers, won[:, None], 1)[:, 0] + self.shift
                pooled = np.maximum(best, 0)
                wrong = softmax(pooled @ self.out + self.bias)
                wrong[np.arange(len(rows)), labels[rows]] -= 1
                wrong /= len(rows)
                back = (wrong @ self.out.T) * (best > 0)
                seen = patches.reshape(len(rows), WINDOW, -1)[np.arange(len(rows))[:, None], won]
                to_patch = back[:, :, None] * self.filters.T[None]
                padded = np.pad(cells[rows], ((0, 0), (0, max(WIDTHS) - 1)))
                taps = padded[np.arange(len(rows))[:, None, None], won[:, :, None] + np.arange(max(WIDTHS))]
                to_embed = np.zeros_like(self.embed)
                np.add.at(to_embed, taps.reshape(-1), to_patch.reshape(-1, EMBED))
                to_embed[0] = 0
                slopes = [to_embed, np.einsum("bf,bfp->pf", back, seen) * mask, back.sum(0), pooled.T @ wrong, wrong.sum(0)]
                step += 1
                for p, g, m, v in zip(params, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(docs: DataFrame, max_docs: int, per_doc: int) -> list[tuple[str, bytes]]:
    """Windows of at most ``max_docs`` labelled documents, the first by a hash of their id."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")  # at most max_docs ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                cells, _, _ = windows([text])
                if has_letter(text):
                    for i in np.unique(np.linspace(0, len(cells) - 1, per_doc).astype(int)):
                        rows.append((doc_id, int(i), lang, cells[i].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "lang", "cells"])

    found = sample.mapInArrow(task, "doc_id long, n long, lang string, cells binary").limit(max_docs * per_doc).toArrow()
    return [row[2:] for row in sorted(zip(*(found.column(i).to_pylist() for i in range(4)), strict=True))]


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, per_doc: int = TRAIN_WINDOWS) -> Network | None:
    """A network from labelled rows that are not held out; None where there are none."""
    rows = training_windows(docs, max_docs, per_doc)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    cells = np.frombuffer(b"".join(c for _, c in rows), dtype=np.uint8).reshape(-1, WINDOW)
    network = Network.fresh(languages)
    network.train(cells, np.array([place[lang] for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_lang_score``; all columns and rows stay as they are.

    Only ``text`` is read. A null text, or one without a letter, is ``und`` with score 0, as is every text when
    there was nothing to learn from.
    """
    at = docs.columns.index("text")
    schema = with_fields(docs.schema, ("_lang_pred", T.StringType()), ("_lang_score", T.DoubleType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column(at))
            known = np.array([network is not None and has_letter(text) for text in texts], dtype=bool)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known.any():
                cells, used, begin = windows([text for text, k in zip(texts, known, strict=True) if k])
                each = network.probabilities(cells) * used[:, None]
                mean = np.add.reduceat(each, begin) / np.add.reduceat(used, begin)[:, None]
                for i, row in zip(np.flatnonzero(known), mean, strict=True):
                    names[i], scores[i] = network.languages[row.argmax()], min(1.0, float(row.max()))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(task, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from those not held out.

    Repeated rows each get their answer; a null ``doc_id`` counts as not held out but is not learnt from;
    other columns are ignored; an empty table gives no rows.
    """
    network = train(doc_rows(docs, "doc_id", "text", "lang"))
    return predict(doc_rows(docs, "doc_id", "text"), network).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in some language: a text without a letter goes, however sure or mixed the others are.

    Where no row is labelled there is no language to name, and every text with a letter stays.
    """
    network = train(doc_rows(docs, "doc_id", "text", "lang"))
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    answers = predict(docs, network)
    return answers.filter(F.col("_lang_pred") != UNKNOWN).select(*(f"`{c}`" for c in docs.columns))
