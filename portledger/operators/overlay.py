"""User corrections over derived holdings: chain of replacements, freshness, active view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from portledger.operators.chains import walk
from portledger.operators.scans import Order, drop_chunks, running, with_chunks
from portledger.operators.skew import attach
from portledger.sources.staging import staged


def overlay_chain(corrections: DataFrame, **limits) -> DataFrame:
    """Adds ``status`` to corrections in arrival order (``seq``) per account.

    Compare-and-swap on the correction in force, the last one accepted: a new id must name it and be
    strictly later; its own id with the same content is a no-op. A refused row leaves no trace. The
    accepted rows are a chain: each one's successor is the first later row that names it rightly.
    """
    names = ("account_ref", "seq", "correction_id", "corrected_at")
    rows = staged(corrections.withColumn("node", F.struct("account_ref", "seq")), "corrections")
    now = rows.select("node", *[F.col(n).alias(f"_{n}") for n in names])
    after = rows.select(*names, F.col("expected_previous").alias("_correction_id"), F.col("account_ref").alias("_account_ref"))
    # Files of many short rows are small: left to a size check, whole tables of corrections would go through the driver.
    follows = now.hint("merge").join(after, ["_account_ref", "_correction_id"]).filter(
        (F.col("seq") > F.col("_seq"))
        & (F.col("corrected_at") > F.col("_corrected_at"))
        & (F.col("correction_id") != F.col("_correction_id"))
    )
    links = follows.groupBy("node").agg(F.struct(F.first("account_ref").alias("account_ref"), F.min("seq").alias("seq")).alias("next"))
    heads = rows.filter("expected_previous is null").groupBy("account_ref").agg(F.min("seq").alias("seq"))
    accepted = walk(links, heads.select(F.struct("account_ref", "seq").alias("node"))).select("node", F.lit(True).alias("_in"))
    judged = staged(rows.hint("merge").join(accepted, "node", "left").drop("node"), "accepted-corrections")

    order = Order(("account_ref",), "seq", "seq", width=1 << 16)
    prior = F.when(F.col("_in"), F.struct("correction_id", "content", "corrected_at"))
    rows = drop_chunks(
        running(with_chunks(judged, order, **limits), order, {"_prev": ("last", prior, False)})
    )
    prev = F.col("_prev")
    same_id = F.col("correction_id") == prev["correction_id"]
    return rows.withColumn(
        "status",
        F.when(F.col("_in"), "COMMIT")
        .when(prev.isNull(), "NOTHING_TO_REPLACE")
        .when(same_id & (F.col("content") == prev["content"]), "DUPLICATE_NOOP")
        .when(same_id, "ID_REUSED")
        .when(~F.col("expected_previous").eqNullSafe(prev["correction_id"]), "PREVIOUS_DIFFERS")
        .otherwise("NOT_LATER"),
    ).drop("_prev", "_in")


def latest_overlay(chain: DataFrame) -> DataFrame:
    """The overlay in force per account: the last committed one."""
    good = chain.filter(F.col("status") == "COMMIT")
    return good.groupBy("account_ref").agg(
        F.max_by(F.struct("correction_id", "corrected_at", "active"), "seq").alias("_o")
    ).select("account_ref", "_o.*")


def later_than_correction(events: DataFrame, overlays: DataFrame, **limits) -> DataFrame:
    """Position events after the overlay of their account: an equi-join, then a filter."""
    current = overlays.select("account_ref", "correction_id", "corrected_at")
    return attach(events, current, ["account_ref"], how="inner", **limits).filter(
        F.col("trade_time") > F.col("corrected_at")
    )


def active_holdings(
    derived: DataFrame, overlay_rows: DataFrame, overlays: DataFrame, events: DataFrame, **limits
) -> DataFrame:
    """Per account: overlay rows while active and fresh, else derived rows; stale ones are flagged."""
    stale = later_than_correction(events, overlays, **limits).select("account_ref").distinct()
    state = overlays.join(stale.withColumn("_late", F.lit(True)), "account_ref", "left").select(
        "account_ref",
        F.col("correction_id").alias("_current"),
        F.when(~F.col("active"), "DERIVED").when(F.col("_late"), "OVERLAY_STALE").otherwise("OVERLAY").alias("basis"),
    )
    from_ledger = attach(derived, state, ["account_ref"], **limits).withColumn(
        "basis", F.coalesce("basis", F.lit("DERIVED"))
    )
    from_ledger = from_ledger.filter(F.col("basis") == "DERIVED").drop("_current")
    corrected = attach(overlay_rows, state, ["account_ref"], how="inner", **limits).filter(
        (F.col("correction_id") == F.col("_current")) & (F.col("basis") != "DERIVED")
    ).drop("_current", "correction_id")
    return from_ledger.unionByName(corrected, allowMissingColumns=True)
