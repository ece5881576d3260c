"""Similarity join on word shingles by PartEnum signatures.

Sizes are cut into bands so that similar sets lie in one band or in neighbouring ones. Within a band the
similarity bounds how many features two sets may differ in, ``k``. The feature domain is hashed into
``k // (d + 1) + 1`` parts, so similar sets differ in at most ``d`` features of some part. A part is cut into ``d + 1`` cells, one of
which none of the differences falls into: the features in a cell, hashed together with band, part and cell, are a
signature, and similar sets share one, always. An empty cell would say nothing: where a part has one, it is
cut anew by another hash, up to LEVELS times; similar sets that shared only the empty cell share one of the
new ones for the same reason. ``d`` is chosen so that a part holds some features, which leaves few parts with an empty
cell at all levels.

Sets that are equal are joined by a digest first. Rows of one signature are sorted next to each other and
compared with the smallest of them (a star); links found so make components, and only pairs of one
signature from different components, not compared yet, are compared afterwards. Comparing is exact.

Each set also has a parity sketch: features are hashed to bits, and a bit says whether an odd number fell on
it. Each feature that two sets differ in changes one bit, so they differ in at least as many features as bits. A pair
that differs in too many bits is not similar and is not made; all others are compared by their sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, discard, doc_rows, release, slices
from portledger.llm.graph import components
from portledger.sources.staging import staged

#: Similar means intersection * 100 >= union * 90; words in a shingle; features that a part should hold; times it is cut.
PERCENT = 90
WORDS = 3
HELD = 16
LEVELS = 12
#: Members of a signature that meet all others in one piece of work, and pairs that a task makes.
MEMBERS, PAIRS = 256, 2_000_000
CACHE_WORDS = 100_000
#: A parity sketch has this many bits, or the next power of two from twice the features.
SKETCH = 1024

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * M2
    x = (x ^ x >> np.uint64(29)) * M1
    return x ^ x >> np.uint64(32)


def size_bands(percent: int, largest: int = 1 << 40) -> tuple[list[int], list[int]]:
    """First and last size of each band."""
    first, last = [1], []
    while first[-1] <= largest:
        last.append(first[-1] * 100 // percent)
        first.append(last[-1] + 1)
    return first[:-1], last


class Shingles:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.n, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.n, len(words))
        if not width:
            return hashes
        rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            rolled = _mixed(rolled * M1 + hashes[i : len(words) - width + 1 + i])
        return np.unique(rolled)


class Signatures:
    """PartEnum signatures of feature sets for a similarity of ``percent``."""

    def __init__(self, percent: int, held: int = HELD):
        self.first, self.last = size_bands(percent)
        self.percent, self.held = percent, held

    def differences(self, band: int) -> int:
        """Similar sets of this band and the one below differ in at most so many features."""
        return 2 * self.last[band] * (100 - self.percent) // (100 + self.percent)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.empty(0, np.uint64)
        band = bisect_right(self.first, len(features)) - 1
        return np.concatenate([self.of_band(features, b) for b in (band, band + 1)])

    def of_band(self, features: np.ndarray, band: int) -> np.ndarray:
        k = self.differences(band)
        if not k:  # equal sets only, which the digest joins
            return np.empty(0, np.uint64)
        # Differences allowed in a part: so many that it holds enough features.
        allowed = min(k, max(1, -(-self.held * k // self.last[band]) - 1))
        parts, cells = k // (allowed + 1) + 1, allowed + 1
        part = ((_mixed(features ^ M2) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        value, out = _mixed(features + M1), []
        for level in range(LEVELS):
            cell = (_mixed(features * M1 + np.uint64(level + 1)) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
            place = part * cells + cell.astype(np.int64)
            sums = np.zeros(parts * cells, dtype=np.uint64)
            np.add.at(sums, place, value)
            empty = (np.bincount(place, minlength=parts * cells) == 0).reshape(parts, cells)
            given = ~empty if level < LEVELS - 1 else np.ones_like(empty)
            if level:
                given &= again[:, None]
            number = np.arange(parts * cells, dtype=np.uint64) + np.uint64((band << 44) + (level << 36))
            out.append(_mixed(sums ^ _mixed(number * M1))[given.reshape(-1)])
            again = empty.any(1) if not level else again & empty.any(1)
            if not again.any():
                break
            kept = again[part]
            features, part, value = features[kept], part[kept], value[kept]
        return np.concatenate(out)


def sketch(features: np.ndarray) -> np.ndarray:
    """Parity of the features on each bit, as signed words; its two halves together make one of half the size."""
    bits = max(SKETCH, 1 << (2 * len(features) - 1).bit_length()) if len(features) else SKETCH
    bit = (_mixed(features * M1 + M2) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(percent: int, a: str, b: str) -> Column:
    """Whether sizes and sketches (columns ``a`` + n, ``a`` + sketch, ...) leave room for the similarity."""
    x, y, m, n = F.col(f"{a}sketch"), F.col(f"{b}sketch"), F.col(f"{a}n"), F.col(f"{b}n")

    def halved(words: Column) -> Column:
        half = (F.size(words) / 2).cast("int")
        return F.zip_with(F.slice(words, 1, half), F.slice(words, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def differ(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda total, one: total + one)

    bits = (
        F.when(F.size(x) == F.size(y), differ(x, y))
        .when(F.size(x) == 2 * F.size(y), differ(halved(x), y))
        .when(F.size(y) == 2 * F.size(x), differ(x, halved(y)))
        .otherwise(0)
    )
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (bits * (100 + percent) <= (m + n) * (100 - percent))


def features(docs: DataFrame, words: int, percent: int, held: int, wanted: str = "both") -> DataFrame:
    """doc_id and ``wanted``: n_shingles, a digest and a sketch of the set ("sets"), its signatures, or both."""
    fields = {"doc_id": "bigint"}
    if wanted != "signatures":
        fields |= {"n_shingles": "bigint", "digest": "binary", "sketch": "array<bigint>"}
    if wanted != "sets":
        fields |= {"signatures": "array<bigint>"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures = Shingles(words), Signatures(percent, held)
        for batch in slices(batches):
            sets = [shingles(text) for text in as_bytes(batch.column(1))]
            columns = [batch.column(0)]
            if wanted != "signatures":
                columns.append(pa.array([len(s) for s in sets], pa.int64()))
                columns.append(pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()))
                columns.append(pa.array([sketch(s) for s in sets], pa.list_(pa.int64())))
            if wanted != "sets":
                found = [signatures(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=list(fields))

    return docs.mapInArrow(task, ", ".join(f"{name} {kind}" for name, kind in fields.items()))


def shared_signatures(sets: DataFrame) -> DataFrame:
    """Rows (signature, doc_id, center) of signatures that several sets have; center is the smallest id.

    One exchange by range of (signature, id), so a frequent signature is split over partitions. In each
    the first id of a signature is its center; a signature that goes on in another partition is
    tied together by the first and last of each partition, at most two rows a partition.
    """
    rows = sets.select(F.explode("signatures").alias("signature"), "doc_id")
    placed = rows.repartitionByRange("signature", "doc_id").sortWithinPartitions("signature", "doc_id")
    schema = "signature bigint, doc_id bigint, center bigint, edge boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = at = None
        opened = False
        for batch in batches:
            if not batch.num_rows:
                continue
            signature, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(signature), dtype=bool)
            new[1:] = signature[1:] != signature[:-1]
            new[0] = not opened or signature[0] != at
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            centers = np.where(start >= 0, doc[np.maximum(start, 0)], center if opened else 0)
            if not opened:
                yield _rows(signature[:1], doc[:1], doc[:1], True)
            keep = ~new & (centers != doc)
            yield _rows(signature[keep], doc[keep], centers[keep], False)
            at, center, opened = signature[-1], centers[-1], True
        if opened:
            yield _rows(np.array([at]), np.array([center]), np.array([center]), True)

    found = staged(placed.mapInArrow(task, schema), "shared-signatures")
    inner = found.filter("not edge").select("signature", "doc_id", "center")
    edges = found.filter("edge").select("signature", "doc_id")
    first = edges.groupBy("signature").agg(F.min("doc_id").alias("center"))
    return inner.unionByName(edges.join(first, "signature").filter("doc_id != center").select("signature", "doc_id", "center"))


def _rows(signature: np.ndarray, doc: np.ndarray, center: np.ndarray, edge: bool) -> pa.RecordBatch:
    columns = [pa.array(signature, pa.int64()), pa.array(doc, pa.int64()), pa.array(center, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(doc), edge))], names=["signature", "doc_id", "center", "edge"])


def similar(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets, made anew from the texts of these rows alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            sets = [shingles(text) for text in as_bytes(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "features"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(task, "doc_id bigint, features array<bigint>")
    sets = staged(sets, "feature-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("features").alias("left")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("features").alias("right")), "b"
    )
    common = both.select("a", "b", (F.size("left") + F.size("right")).alias("sizes"), F.size(F.array_intersect("left", "right")).alias("both"))
    return common.filter(F.col("both") * 100 >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")


def folded(sketch: Column, words: int) -> Column:
    """A sketch folded to fewer words (a power of two); it still differs in no more bits than the sets."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda j: F.aggregate(
            F.filter(sketch, lambda w, i: i % words == j), F.lit(0).cast("long"), lambda total, w: total.bitwiseXOR(w)
        ),
    )


def jaccard_classes(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, held: int = HELD, carried: int = 16, written: bool = True
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    ``docs`` needs doc_id and text; other columns are ignored. Null and white texts have no shingles and are
    linked with nothing; a row without an id has a null component. Repeated rows get the same answer
    each. An empty table gives no rows. A text of any length is one set. ``carried`` is how many words (a power of
    two) of its sketch go with a signature of a set; the pairs found are held against the whole sketches afterwards.
    Signatures are either ``written`` once, or made anew from the texts where they are sampled and sorted: that is two
    more passes and a third less disk.
    """
    spark = docs.sparkSession
    release(spark)  # what earlier steps have left on disk
    docs = doc_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.filter("doc_id is not null")
    if written:
        signed = staged(features(docs, words, percent, held), "shingle-signatures")
        sets = staged(signed.drop("signatures"), "shingle-sets")
        shared = staged(shared_signatures(signed.filter("doc_id is not null")), "multiple-signatures")
        discard(signed)
    else:
        sets = staged(features(docs, words, percent, held, "sets"), "shingle-sets")
        shared = staged(shared_signatures(features(known, words, percent, held, "signatures")), "multiple-signatures")
    # Equal sets act through the smallest id among them.
    roots = staged(equal_sets(sets), "equal-sets")
    star = shared.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    profiles = sets.filter("doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    star = staged(promising(between_roots(star, roots), profiles, percent), "star-pairs")
    links = staged(similar(star, known, words, percent), "star-links")
    # Pairs that the stars leave: one signature, different components.
    members = shared.select("signature", "doc_id").unionByName(
        shared.select("signature", F.col("center").alias("doc_id")).distinct()
    )
    label = components(links)
    members = members.join(roots, "doc_id").select("signature", "root").distinct()
    members = members.join(label, members.root == label.node, "left").select(
        "signature", "root", F.coalesce("component", "root").alias("component")
    )
    # A frequent signature is cut: a piece of its members meets all of them.
    mixed = members.groupBy("signature").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")
    )
    mixed = mixed.filter("low < high").withColumn("pieces", F.ceil(F.col("members") / MEMBERS).cast("int"))
    brief = profiles.withColumn("sketch", folded(F.col("sketch"), carried))
    members = members.join(mixed, "signature").join(brief, members.root == brief.doc_id)
    members = staged(members.select("signature", "root", "component", "n", "sketch", "members", "pieces"), "open-members")
    discard(shared)
    pairs = members.agg(F.sum("members")).first()[0] or 0
    # Partitions by the pairs they make: the rows that make them are too few to tell.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS + 1)

    def side(name: str, piece: Column) -> DataFrame:
        rows = members.withColumn("piece", piece)
        rows = rows.select("signature", "piece", *(F.col(c).alias(f"{name}_{c}") for c in ("root", "component", "n", "sketch")))
        return rows.repartition(tasks, "signature", "piece")

    left = side("x", F.pmod(F.xxhash64("root"), F.col("pieces")).cast("int"))
    right = side("y", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    same = (left.signature == right.signature) & (left.piece == right.piece)
    close = same & (F.col("x_component") < F.col("y_component")) & may_be_similar(percent, "x_", "y_")
    across = left.join(right, close).select(F.least("x_root", "y_root").alias("a"), F.greatest("x_root", "y_root").alias("b")).distinct()
    across = staged(across.join(star, ["a", "b"], "left_anti"), "open-candidates")
    across = staged(promising(across, profiles, percent), "open-pairs")
    links = staged(links.unionByName(similar(across, known, words, percent)), "all-links")
    label = components(links)
    linked = roots.join(label, roots.root == label.node, "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component", "root").alias("component_id")
    )
    return sets.join(linked, sets.doc_id == linked._id, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def equal_sets(sets: DataFrame) -> DataFrame:
    """doc_id and root, the smallest id with the same set, of every id with shingles."""
    filled = sets.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    least = filled.groupBy("digest").agg(F.min("doc_id").alias("root"))
    return filled.join(least, "digest").groupBy("doc_id").agg(F.min("root").alias("root"))


def between_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) with both ids replaced by their roots, each once, smaller first."""
    first = roots.select(F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    second = roots.select(F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    both = pairs.join(first, "a").join(second, "b").filter("ra != rb")
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def promising(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    first = profiles.select(F.col("doc_id").alias("a"), F.col("n").alias("x_n"), F.col("sketch").alias("x_sketch"))
    second = profiles.select(F.col("doc_id").alias("b"), F.col("n").alias("y_n"), F.col("sketch").alias("y_sketch"))
    return pairs.join(first, "a").join(second, "b").filter(may_be_similar(percent, "x_", "y_")).select("a", "b").distinct()


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, held: int = HELD) -> DataFrame:
    """The document with the smallest id of each group, with all its columns; rows without an id stay."""
    classes = jaccard_classes(docs, words, percent, held, written=False).filter("doc_id is not null")
    gone = classes.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
