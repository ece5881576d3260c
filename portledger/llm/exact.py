"""Exact deduplication by sorting content.

Spark samples splitters of the sort key and range-partitions the rows; each partition is sorted (on disk
where it does not fit), which places equal texts next to each other, and a streaming pass compares every
normalised text in full with the one before it. A run of equal neighbours is a group. The key is the first
normalised bytes, then a digest of all of them, then the order in which rows of a group are preferred, so that
sampled keys stay short and a group of any size is split over partitions. Only the first and last run
of a partition can go on in another one; those, at most two a partition, are joined by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portledger.llm.common import SPACE_CLASS
from portledger.sources.staging import staged

#: Normalised bytes in the splitters.
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def sorted_runs(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with the partition and the run of equal neighbours it fell into."""
    kept = {f"_carry_{i}": F.col(f"`{c}`") for i, c in enumerate(carry)}
    digest = F.sha2(normalised(F.col("text")), 256)
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce("text", F.lit("")).alias("_text"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"),
        F.substring(normalised(F.col("text")), 1, PREFIX).alias("_prefix"),
        digest.alias("text_sha256"),
        *(column.alias(name) for name, column in kept.items()),
    )
    order = ["_prefix", "text_sha256", F.col("_chars").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.repartitionByRange(*order).withColumn("_norm", normalised(F.col("_text")))
    placed = placed.sortWithinPartitions("_prefix", "text_sha256", "_norm", *order[2:])
    slim = placed.select("doc_id", "_chars", "text_sha256", "_norm", *kept)
    out = T.StructType(
        [f for f in slim.schema if f.name != "_norm"]
        + [T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_first", T.BooleanType())]
    )
    at = slim.columns.index("_norm")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch.column(at)
            first = np.ones(batch.num_rows, dtype=bool)
            first[0] = last is None or norm[0].as_py() != last
            if batch.num_rows > 1:
                first[1:] = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            runs = run + np.cumsum(first)
            run, last = int(runs[-1]), norm[batch.num_rows - 1].as_py()
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(runs), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return slim.mapInArrow(task, out)


def exact_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its group of equal texts and whether it is the one that stays.

    Texts are equal when they are identical without ASCII white space; a null text counts as empty. Of a
    group the row with the most code points stays, then the smallest ``doc_id`` (nulls last); among
    repeated rows exactly one stays. ``carry`` names columns to keep, as ``_carry_0`` and so on; others are
    ignored. An empty table gives no rows.
    """
    rows = staged(sorted_runs(docs, carry), "content-runs")
    runs = rows.groupBy("_part", "_run").agg(
        F.count("*").alias("_size"),
        F.max(F.when(F.col("_first"), F.col("doc_id"))).alias("_keep"),
        F.first("text_sha256").alias("_digest"),
    )
    ends = rows.groupBy("_part").agg(F.max("_run").alias("_last"))
    runs = runs.join(F.broadcast(ends), "_part")  # one row a partition
    edge = (F.col("_run") == 0) | (F.col("_run") == F.col("_last"))
    # At most two rows a partition.
    across = (
        runs.filter(edge)
        .groupBy(F.col("_digest").alias("_edge"))
        .agg(F.sum("_size").alias("_all"), F.min(F.struct("_part", "_keep")).alias("_head"))
    )
    runs = runs.join(F.broadcast(across), edge & (F.col("_digest") == F.col("_edge")), "left").select(
        F.col("_part"),
        F.col("_run"),
        F.when(F.col("_edge").isNull(), F.col("_keep")).otherwise(F.col("_head._keep")).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        F.coalesce(F.col("_head._part") == F.col("_part"), F.lit(True)).alias("_heads"),
    )
    joined = rows.join(runs, ["_part", "_run"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("_first") & F.col("_heads")).alias("kept"),
        "text_sha256",
        *(c for c in rows.columns if c.startswith("_carry_")),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    groups = exact_groups(docs, tuple(docs.columns)).filter("kept")
    return groups.select(*(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(docs.columns)))
