"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor when the smallest of its inner s-mers, by hash, is the first or the last one.
That depends on the k-mer alone, so equal stretches of text have equal anchors whatever surrounds them.
A fingerprint holds the anchors with hashes below a fixed limit, and the smallest ones where these are few, with the
place where each first stands; it grows with the text. Two fingerprints are alike by the share of their anchors that
both have in passages: an anchor counts when the next one that both have, or the one before, lies as far from it in
both texts, but for a part of that distance.

The text after each document is found by cutting the ids into ranges at sampled ids, sending the texts to
their ranges once, and sending the first text of a range to the range before it as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, doc_rows, slices

K, S = 12, 4
#: Anchors in a fingerprint at least, and the hashes (of 2 ** 32) that it holds all anchors of.
ANCHORS, LIMIT = 64, (1 << 32) // 16
#: Two anchors of a passage may stand apart in both texts by so many bytes and this share of their distance.
LEAST_DRIFT, DRIFT = 64, 1 / 8

ANCHOR = np.dtype([("hash", "<u4"), ("at", "<u4")])
ROWS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)


def syncmers(text: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers; ``s`` is 4 or 8."""
    n = len(text) - s + 1
    words = np.empty(max(n, 0), dtype=np.uint64)
    for shift in range(min(s, max(n, 0))):
        count = (n - shift + s - 1) // s
        words[shift::s] = np.frombuffer(text, dtype=f"<u{s}", count=count, offset=shift)
    inner = _mixed(words)
    window = k - s + 1
    least, span = inner, 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    if not len(least):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[window - 1 :] == least))
    joined = inner[at]
    for part in range(4, window, 4):  # s-mers that cover the k-mer
        joined = _mixed(joined ^ inner[at + part])
    return (joined >> np.uint64(32)).astype(np.uint32), at


def fingerprint(text: bytes) -> np.ndarray:
    """The anchors below the limit, ANCHORS at least; a text without a syncmer has one anchor, an empty text none."""
    if not text:
        return np.empty(0, ANCHOR)
    hashes, at = syncmers(text)
    if not len(hashes):
        hashes, at = np.array([xxhash.xxh32_intdigest(text)], np.uint32), np.zeros(1, np.int64)
    if len(hashes) > 32 * ANCHORS:
        low = np.flatnonzero(hashes < LIMIT)
        if len(np.unique(hashes[low])) >= ANCHORS:
            hashes, at = hashes[low], at[low]
    hashes, first = np.unique(hashes, return_index=True)
    count = max(ANCHORS, int(np.searchsorted(hashes, LIMIT)))
    out = np.empty(min(len(hashes), count), ANCHOR)
    out["hash"], out["at"] = hashes[:count], at[first[:count]]
    return out


def as_text(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ANCHOR)


def complete(anchors: np.ndarray) -> int:
    """The hash below which a fingerprint holds every anchor of its text."""
    return 1 << 32 if len(anchors) < ANCHORS else max(LIMIT, int(anchors["hash"][-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice share of the anchors that match in passages, among those that both fingerprints would hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    limit = min(complete(a), complete(b))
    a, b = a[a["hash"] < limit], b[b["hash"] < limit]
    _, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    x, y = a["at"][i].astype(np.int64), b["at"][j].astype(np.int64)
    order = np.lexsort((y, x))
    # The two starts are a match as well.
    x, y = np.append(0, x[order]), np.append(0, y[order])
    apart, other = np.diff(x), np.diff(y)
    agree = np.abs(apart - other) <= LEAST_DRIFT + DRIFT * np.maximum(apart, np.abs(other))
    shared = int((agree | np.append(agree[1:], False)).sum())
    return 2 * shared / max(1, len(a) + len(b))


def edited(text: str, after: str) -> str:
    """The second half of the code points replaced by as many from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def ranges(docs: DataFrame, parts: int) -> list[int]:
    """First ids of at most ``parts`` ranges of about as many rows; the driver sees no other id."""
    shares = [i / parts for i in range(parts)]
    row = docs.agg(
        F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, max(10_000, 100 * parts)).alias("cuts")
    ).first()
    return sorted({row.low, *row.cuts}) if row.low is not None else []


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Each row in its range, in order, followed by a copy of the first row of the next range.

    Rows without an id come last. The range after the last is the first.
    """
    firsts = np.array(ranges(docs.select("doc_id"), parts), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy().astype(np.int64)
        at = np.where(known, np.searchsorted(firsts, values, side="right") - 1, max(len(firsts) - 1, 0)).astype(np.int32)
        first = known & (firsts[at] == values) if len(firsts) else np.zeros(len(values), bool)
        return pd.Series([[a, (a - 1) % len(firsts)] if f else [a] for a, f in zip(at, first, strict=True)])

    sent = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("_copy", "_part"))
    placed = sent.repartitionById(max(1, len(firsts)), "_part")
    return placed.sortWithinPartitions("_copy", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``docs`` needs doc_id and text; other columns are ignored. A null text counts as empty. Rows come in order of
    id, rows of one id in order of their text, rows without an id last; after the last comes the first. The
    fingerprint of an empty text is empty, like another empty one and unlike any other. An empty table gives no rows.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = held = None
        copied = False
        for batch in slices(batches):
            rows = []
            for doc_id, text, copy in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if copied:
                    break
                now = (doc_id, text, text.decode("utf-8", "replace"), fingerprint(text))
                head = head or now
                if held:
                    rows.append(_row(held, now))
                held, copied = now, copy == 1
            yield _batch(rows)
        if held and not copied:  # no id in the whole table
            yield _batch([_row(held, head)])

    placed = with_next(doc_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), parts)
    return placed.select("doc_id", "text", "_copy").mapInArrow(task, ROWS)


def _row(held: tuple, after: tuple) -> tuple:
    doc_id, text, chars, own = held
    changed = edited(chars, after[2]).encode()
    its = fingerprint(changed)
    return (
        doc_id,
        len(chars),
        hashlib.sha256(changed).hexdigest(),
        as_text(own),
        as_text(its),
        likeness(own, its),
        likeness(own, after[3]),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in ROWS.split(", ")]
    kinds = (pa.int64(), pa.int64(), *(pa.string(),) * 3, pa.float64(), pa.float64())
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
