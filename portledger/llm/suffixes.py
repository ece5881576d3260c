"""Removal of long repeated byte strings by sorting suffixes.

Every string of LENGTH bytes belongs to the bucket of its smallest hash of K bytes, so equal strings meet
in one bucket. Neighbouring starts of one bucket make a run, and a run's bytes a segment. Equal segments are
counted; where one occurs twice, all its strings are repeated. Buckets with different segments, one copy of each, go
to suffix sorting in two stages: suffixes smaller than their successor are sorted directly, the others
follow from their successors in a scan over the buckets of first bytes, and neighbours in the order whose
common prefix reaches LENGTH are repeated. A bucket of more than GROUP_BYTES is sorted in groups; strings that are
single in theirs are then counted by digest across the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, doc_rows, slices
from portledger.sources.staging import staged

LENGTH = 400
#: Bytes under one hash; a string has LENGTH - K + 1 of them.
K = 100
#: Starts in a run at most, and bytes of a text hashed at a time.
RUN = 4096
BLOCK = 1 << 20
#: Bytes of small buckets sorted together, and of one bucket: this bounds the memory of a task.
SORTED_BYTES = 1 << 18
GROUP_BYTES = 1 << 22

_RANDOM = np.random.default_rng(97)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Buckets:
    """Runs of starts whose strings have the same smallest hash."""

    def __init__(self, length: int = LENGTH, k: int = K):
        self.length, self.k, self.window = length, k, length - k + 1
        n = BLOCK + length
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=total[1:])
        return total

    def rolled(self, total: np.ndarray, begin: int, end: int, size: int) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes that start in a stretch."""
        return (total[begin + size : end + size] - total[begin:end]) * self.down[begin:end]

    def hashes(self, total: np.ndarray) -> np.ndarray:
        x = self.rolled(total, 0, len(total) - self.k, self.k)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(29)

    def runs(self, text: bytes) -> Iterator[tuple[int, int, int, int, bool]]:
        """Bucket, digest of the segment, first start, starts, and whether a segment may repeat itself."""
        for begin in range(0, len(text) - self.length + 1, BLOCK):
            part = text[begin : begin + BLOCK + self.length - 1]
            total = self.sums(np.frombuffer(part, dtype=np.uint8))
            hashed = self.hashes(total)
            least, span = hashed, 1
            while span < self.window:
                step = min(span, self.window - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
            if np.diff(first).max() > RUN:
                first = np.unique(np.concatenate([np.arange(a, b, RUN) for a, b in zip(first[:-1], first[1:], strict=True)] + [first[-1:]]))
            keys = least[first[:-1]]
            for key, a, b in zip(keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
                again = int(np.count_nonzero(hashed[a : b - 1 + self.window] == key)) > 1
                if again:  # the smallest hash stands twice; does a whole string?
                    again = len(np.unique(self.rolled(total, a, b, self.length))) < b - a
                digest = xxhash.xxh3_64_intdigest(part[a : b - 1 + self.length])
                yield int(key), digest, begin + a, b - a, again


def buckets(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Size, digest and runs of every text."""
    schema = (
        "doc_id bigint, _id bigint, _content bigint, n_bytes bigint, sha256 string, "
        "key array<bigint>, segment array<bigint>, start array<int>, starts array<int>, again array<boolean>"
    )
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Buckets(length, k)
        for batch in slices(batches):
            texts = as_bytes(batch.column(3))
            found = [list(finder.runs(text)) for text in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            flat = list(zip(*(run for f in found for run in f), strict=True)) or [()] * 5
            flat[:2] = [np.array(values, dtype=np.uint64).view(np.int64) for values in flat[:2]]
            columns = [
                *batch.columns[:3],
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                *(pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in zip(flat, kinds, strict=True)),
            ]
            names = ["doc_id", "_id", "_content", "n_bytes", "sha256", "key", "segment", "start", "starts", "again"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "_id", "_content", "text").mapInArrow(task, schema)


def suffix_order(text: bytes, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` starts (a mask) in the order of their suffixes, to a depth of LENGTH at least, with some others."""
    data = np.frombuffer(text + b"\x00\xff", dtype=np.uint8)
    n = len(text)
    # A suffix is smaller than its successor when the first byte that differs from its own is larger.
    change = np.flatnonzero(data[1:] != data[:-1])
    rises = data[1:][change] > data[:-1][change]
    small = rises[np.searchsorted(change, np.arange(n + 1))]
    wanted = np.append(wanted, False)
    # A larger suffix needs its successor, and so on up to the next smaller one.
    next_small = np.searchsorted(np.flatnonzero(small), np.arange(n + 1))
    ends = np.flatnonzero(small)[next_small]
    steps = np.zeros(n + 2, dtype=np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(steps, at, 1)
    np.add.at(steps, ends[at] + 1, -1)
    needed = np.cumsum(steps[:-1]) > 0

    direct = np.flatnonzero(needed & small)
    direct = direct[np.argsort(data[direct], kind="stable")]
    heads = data[direct]
    induced: dict[int, list[np.ndarray]] = {}
    order: list[np.ndarray] = []
    for byte in np.unique(data[:-1][needed]).tolist():
        larger = [*induced.pop(byte, [])]
        latest = np.concatenate(larger) if larger else np.empty(0, np.int64)
        while len(latest):
            before = latest[latest > 0] - 1
            latest = before[needed[before] & ~small[before] & (data[before] == byte)]
            larger.append(latest)
        a, b = np.searchsorted(heads, [byte, byte + 1])
        strings = [text[i : i + LENGTH] for i in direct[a:b].tolist()]
        ordered = direct[a:b][sorted(range(len(strings)), key=strings.__getitem__)]
        bucket = np.concatenate([*larger, ordered])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & ~small[before] & (data[before] > byte)]
        by = np.argsort(data[before], kind="stable")
        before = before[by]
        cuts = np.flatnonzero(np.diff(data[before])) + 1
        for part in np.split(before, cuts):
            if len(part):
                induced.setdefault(int(data[part[0]]), []).append(part)
    return np.concatenate(order) if order else np.empty(0, np.int64)


FOUND = "key bigint, segment bigint, starts int, offset int, many int, digest binary"


def repeated(segments: list[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """Rows of FOUND: stretches of repeated starts, and single strings of buckets sorted in several groups.

    A segment is (key, group, groups, segment, starts, counted, bytes); ``counted`` ones are known to be repeated.
    """
    text = b"".join(s[6] for s in segments)
    begin = np.concatenate([[0], np.cumsum([len(s[6]) for s in segments])])
    wanted = np.zeros(len(text), dtype=bool)
    for at, s in zip(begin.tolist(), segments, strict=False):
        wanted[at : at + s[4]] = True
    order = suffix_order(text, wanted)
    order = order[(order < len(text))]
    order = order[wanted[order]]
    places = order.tolist()
    same = np.array([text[a : a + length] == text[b : b + length] for a, b in zip(places, places[1:], strict=False)], dtype=bool)
    twice = np.zeros(len(text), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for at, s in zip(begin.tolist(), segments, strict=False):
        key, _, _, segment, starts, counted, _ = s
        if not counted:
            steps = np.flatnonzero(np.diff(np.concatenate([[0], twice[at : at + starts].view(np.int8), [0]])))
            for a, b in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True):
                yield key, segment, starts, a, b - a, None
    if any(s[2] > 1 for s in segments):
        # One string of each kind stands for its group.
        first = np.ones(len(order), dtype=bool)
        first[1:] = ~same
        for place in order[first].tolist():
            i = int(np.searchsorted(begin, place, side="right")) - 1
            key, _, groups, segment, starts, _, _ = segments[i]
            if groups > 1:
                yield key, segment, starts, place - int(begin[i]), 1, xxhash.xxh3_128_digest(text[place : place + length])


def _found(rows: Iterator[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def sort_segments(cut: DataFrame, length: int) -> DataFrame:
    """Rows of FOUND for segments placed by bucket and group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED_BYTES and row[:2] != held[-1][:2]:
                    yield _found(repeated(held, length))
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield _found(repeated(held, length))

    placed = cut.repartition("key", "group").sortWithinPartitions("key", "group")
    return placed.mapInArrow(task, FOUND)


def cut_segments(docs: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """The bytes of each segment of ``todo``, from its first place."""
    schema = "key bigint, group int, groups int, segment bigint, starts int, counted boolean, bytes binary"
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    pieces = todo.groupBy("_id", "_content").agg(F.collect_list(F.struct("key", "group", "groups", "segment", "starts", "counted", "start")).alias("_pieces"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for text, found in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for p in found:
                    rows.append((*(p[n] for n in names[:-1]), text[p["start"] : p["start"] + p["starts"] + length - 1]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.join(pieces, ["_id", "_content"]).dropDuplicates(["_id", "_content"])
    return rows.select("text", "_pieces").mapInArrow(task, schema)


def kept_parts(docs: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """What stays of texts of which something goes: _id, _content, n_removed, n_spans, kept_sha256."""
    schema = "_id bigint, _content bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    gone = stretches.groupBy("_id", "_content").agg(F.collect_list(F.struct("at", "many")).alias("_gone"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for id_, content, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                steps = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(steps, [p["at"] for p in found], 1)
                np.add.at(steps, [p["at"] + p["many"] + length - 1 for p in found], -1)
                out = np.cumsum(steps[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], out.view(np.int8)])) == 1))
                left = np.frombuffer(text, dtype=np.uint8)[~out].tobytes()
                rows.append((id_, content, int(out.sum()), spans, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    joined = docs.join(gone, ["_id", "_content"]).dropDuplicates(["_id", "_content"])
    return joined.select("_id", "_content", "text", "_gone").mapInArrow(task, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    ``docs`` needs doc_id and text; other columns are ignored. A null text counts as empty, and a text of
    fewer than ``length`` bytes keeps all. Repeated rows repeat their text, so long ones lose it; they are worked on once.
    Texts of any length are cut where their hashes say.
    Rows without an id are treated like others. ``group`` bounds the bytes of a bucket sorted together. An empty table gives no rows.
    """
    docs = doc_rows(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_content"),
        "text",
    )
    sets = staged(buckets(docs, length, k), "suffix-buckets")
    # Of rows repeated with their id one stands for two: that is enough to make its strings repeated.
    names = ["_id", "_content"]
    copies = sets.groupBy(*names).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(*names, F.lit(2).alias("_copies"))
    marked = sets.join(staged(copies, "repeated-rows"), names, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    once = marked.filter("_copies = 1").unionByName(marked.filter("_copies = 2").dropDuplicates(names))
    runs = once.select(*names, "_copies", F.explode(F.arrays_zip("key", "segment", "start", "starts", "again")).alias("r")).select(*names, "_copies", "r.*")
    several = runs.groupBy("key").agg(F.sum("_copies").alias("_n"), F.max("again").alias("_again"), (F.min("segment") < F.max("segment")).alias("_differ"))
    several = several.filter("_n > 1 or _again").select("key", (F.col("_differ") | F.col("_again")).alias("_sort"))
    runs = staged(runs.join(several, "key"), "shared-buckets")
    segments = runs.groupBy("key", "segment", "starts").agg(
        (F.sum("_copies") > 1).alias("counted"), F.max("_sort").alias("_sort"), F.min(F.struct("_id", "_content", "start")).alias("_at")
    )
    segments = staged(segments, "segments")
    todo = segments.filter("_sort")
    kinds = todo.groupBy("key").agg(F.ceil(F.sum(F.col("starts") + length) / group).cast("int").alias("groups"))
    todo = todo.join(kinds, "key").select(
        "_at.*", "key", "segment", "starts", "counted", "groups", F.pmod(F.xxhash64("segment"), F.col("groups")).cast("int").alias("group")
    )
    found = staged(sort_segments(cut_segments(docs, todo, length), length), "sorted-suffixes")
    strings = found.filter("digest is not null")
    across = strings.groupBy("digest").agg(F.count("*").alias("_n")).filter("_n > 1")
    wide = strings.join(across, "digest").select("key", "segment", "starts", "offset", "many")
    whole = segments.filter("counted").select("key", "segment", "starts", F.lit(0).alias("offset"), F.col("starts").alias("many"))
    marks = found.filter("digest is null").select("key", "segment", "starts", "offset", "many").unionByName(wide).unionByName(whole)
    stretches = runs.join(marks, ["key", "segment", "starts"]).select("_id", "_content", (F.col("start") + F.col("offset")).alias("at"), "many")
    kept = kept_parts(docs, stretches, length)
    return sets.select("doc_id", "_id", "_content", "n_bytes", "sha256").join(kept, ["_id", "_content"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
