"""Sinks: whole-slice replacement, outcome tables, and writes behind a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from portledger.sources.staging import staged


class GateClosed(ValueError):
    """A validator found violations, so nothing was written."""


def require_clean(violations: DataFrame, sample: int = 3) -> None:
    """Stop before a write when there is any violation; shows the first few."""
    found = violations.limit(sample).collect()
    if found:
        raise GateClosed("; ".join(str(row.asDict()) for row in found))


def upsert_slices(rows: DataFrame, path: str, by: str) -> None:
    """Replace exactly the partitions the rows cover, leaving all others alone."""
    (
        rows.repartition(by)
        .sortWithinPartitions(by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def write_sorted(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrite a table in global key order; range partitions keep the sort parallel."""
    rows.orderBy(*keys).write.mode("overwrite").parquet(path)


def append_new(path: str, incoming: DataFrame, key: str) -> None:
    """Append rows by id: known equal rows are no-ops, changed ones close the gate."""
    from portledger.operators.ledger import append_idempotent

    existing = incoming.sparkSession.read.parquet(path)
    judged = staged(append_idempotent(existing, incoming, key), "judged")
    require_clean(judged.filter(F.col("outcome") == "CONFLICT").select(key, "outcome"))
    judged.filter(F.col("outcome") == "APPENDED").drop("outcome").write.mode("append").parquet(path)
