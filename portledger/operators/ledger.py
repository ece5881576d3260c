"""Broker-event ledgers: visibility, contracts, deduplication, merging and batch gates.

Groups are only ever reduced by partially aggregated minima and maxima and
joined back with hot keys salted, so copies of one id never meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from portledger.functions.columns import (
    alias_ticker,
    content_hash,
    event_signature,
    known_text,
    matches_any,
    sender_address,
    stable_index_id,
    text,
    valid_email,
    valid_event_id,
    valid_ticker,
)
from portledger.operators.chains import ends, walk
from portledger.operators.scans import Order, drop_chunks, running, with_chunks
from portledger.operators.skew import attach
from portledger.sources.staging import staged

RESOLVED = ("RESOLVED", "FALSE_POSITIVE")
FINAL_STATUSES = ("COMMITTED", "IGNORED", "QUARANTINED", "ANCHOR_EVIDENCE")


# --- filters -----------------------------------------------------------------

def visible_as_of(df: DataFrame, as_of: Column, *times: str) -> DataFrame:
    """Rows whose event and learn times are all known by ``as_of``."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(t) <= as_of for t in times]))


def position_affecting(trades_only: bool = False) -> Column:
    kind, status = F.upper(F.trim("event_type")), F.upper(F.trim("status"))
    trade = (kind == "TRADE") & status.isin("FILLED", "PARTIALLY_FILLED")
    reward = (kind == "STOCK_REWARD") & (status == "CREDITED")
    moves = F.lower(F.trim(F.col("affects_position").cast("string"))).isin("true", "1", "yes")
    sure = F.upper(F.trim("parse_confidence")) == "CONFIRMED"
    return F.coalesce(moves & sure & (trade if trades_only else trade | reward), F.lit(False))


def nonconforming(df: DataFrame) -> DataFrame:
    """Rows that move a position but break the event contract."""
    moves = F.lower(F.trim(F.col("affects_position").cast("string"))).isin("true", "1", "yes")
    return df.filter(F.coalesce(moves, F.lit(False)) & ~position_affecting())


def source_rule(account: str, senders: Sequence[str], patterns: Sequence[str]) -> Column:
    """Why a row may not be trusted: account, sender or subject; NULL when it may."""
    allowed = [s.strip().lower() for s in senders]
    return (
        F.when(~F.lower(F.trim("source_account")).eqNullSafe(account.strip().lower()), "OTHER_ACCOUNT")
        .when(~F.coalesce(sender_address(F.col("sender")).isin(*allowed), F.lit(False)), "SENDER_NOT_LISTED")
        .when(~matches_any(F.trim("subject"), patterns), "SUBJECT_NOT_CONFIRMED")
    )


def trade_time_rule(now: Column | None = None) -> Column:
    """Execution and notification times must agree; in live mode none lies in the future."""
    gap = F.unix_micros("trade_time") - F.unix_micros("message_received_at")
    proxy = F.upper("trade_time_source") == "NOTIFICATION_TIME_PROXY"
    exact = F.upper("trade_time_source") == "BROKER_EXECUTION_TIME"
    rule = (
        F.when(~F.coalesce(proxy | exact, F.lit(False)), "UNKNOWN_TIME_SOURCE")
        .when(proxy & (F.abs(gap) > 1_000_000), "PROXY_DIFFERS_FROM_NOTIFICATION")
        .when(exact & (gap > 300_000_000), "EXECUTED_AFTER_NOTIFICATION")
    )
    if now is not None:
        limit = now + F.expr("interval 5 minutes")
        late = (F.col("trade_time") > limit) | (F.col("message_received_at") > limit)
        rule = F.coalesce(rule, F.when(late, "FUTURE_DATED"))
    return rule


def after_anchor_before_cutoff(df: DataFrame, anchor_at: Column, cutoff: Column) -> DataFrame:
    """Adds ``usage``: applied, or why the row is ignored."""
    return df.withColumn(
        "usage",
        F.when(F.col("trade_time") <= anchor_at, "BEFORE_ANCHOR")
        .when((F.col("trade_time") > cutoff) | (F.col("message_received_at") > cutoff), "AFTER_CUTOFF")
        .otherwise("APPLIED"),
    )


def aliased(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumn("ticker", alias_ticker(F.upper(F.trim("ticker")), aliases))


# --- latest and first rows ----------------------------------------------------

def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row per key in ledger order; a blank key stands for its own row."""
    rest = [c for c in df.columns if c != key]
    own = F.coalesce(text(F.col(key)), F.concat(F.lit("__row_"), F.to_json(F.array(*[F.col(c).cast("string") for c in order]))))
    return (
        df.groupBy(own.alias(key))
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(key, "_r.*")
    )


def dedup_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], signature: Column, **limits
) -> DataFrame:
    """Adds ``dedup``: FIRST, DUPLICATE (equal to the first) or CONFLICT (differs from it)."""
    signed = df.withColumn("_sig", signature)
    first = signed.groupBy(*keys).agg(
        F.min(F.struct(*order, "_sig")).alias("_first"),
    )
    rows = attach(signed, first, keys, **limits)
    mine = F.struct(*order, "_sig") == F.col("_first")
    same = F.col("_sig") == F.col("_first._sig")
    return rows.withColumn(
        "dedup", F.when(mine, "FIRST").when(same, "DUPLICATE").otherwise("CONFLICT")
    ).drop("_sig", "_first")


def dedup_bars(bars: DataFrame, as_of: Column, **limits) -> DataFrame:
    """Final visible minutes, first by id, then by (ticker, instant, type).

    Id conflicts are judged on all rows, economic conflicts only on visible
    final ones; both come back labelled.
    """
    by_id = dedup_first(bars, ["bar_id"], ["seq"], content_hash([c for c in bars.columns if c != "seq"]), **limits)
    kept = by_id.filter(F.col("dedup") == "FIRST").drop("dedup")
    kept = final_minutes(visible_as_of(kept, as_of, "bar_at", "collected_at"))
    by_key = dedup_first(
        kept, ["ticker", "bar_at", "bar_type"], ["seq"], F.col("close").cast("string"), **limits
    )
    conflicts = by_id.filter(F.col("dedup") == "CONFLICT").withColumn("dedup", F.lit("ID_CONFLICT"))
    return by_key.unionByName(conflicts.withColumn("price_at", F.lit(None).cast("timestamp")))


def final_minutes(bars: DataFrame) -> DataFrame:
    """Drop minutes collected before they ended; add ``price_at``, the end of the bar."""
    minute = F.col("bar_type") == "INTRADAY"
    price_at = F.when(minute, F.col("bar_at") + F.expr("interval 1 minute")).otherwise(F.col("bar_at"))
    return bars.withColumn("price_at", price_at).filter(
        ~minute | (F.col("collected_at") >= F.col("price_at"))
    )


def bar_rules(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``rule``: why a bar is invalid for its session, NULL when it is valid."""
    days = F.broadcast(calendar.select("session_date", "open_ts", "close_ts"))
    rows = bars.join(days, "session_date", "left")
    minute = F.col("bar_type") == "INTRADAY"
    end = F.col("bar_at") + F.expr("interval 1 minute")
    price = F.col("close")
    rule = (
        F.when(~F.coalesce(F.col("bar_id").rlike(r"^[A-Za-z0-9._:-]{6,200}$"), F.lit(False)), "BAD_ID")
        .when(~valid_ticker(F.col("ticker")), "BAD_TICKER")
        .when(~F.coalesce(F.col("bar_type").isin("INTRADAY", "DAILY_CLOSE"), F.lit(False)), "BAD_TYPE")
        .when(F.trim(F.coalesce("source", F.lit(""))) == "", "NO_SOURCE")
        .when(price.isNull() | F.isnan(price) | (price <= 0) | (price == float("inf")), "BAD_PRICE")
        .when(F.col("collected_at") < F.col("bar_at"), "COLLECTED_BEFORE_BAR")
        .when(minute & (F.col("collected_at") < end), "MINUTE_NOT_FINAL")
        .when(F.col("open_ts").isNull(), "NOT_A_SESSION")
        .when(~minute & (F.col("bar_at") != F.col("close_ts")), "NOT_AT_CLOSE")
        .when(minute & ((F.col("bar_at") < F.col("open_ts")) | (end > F.col("close_ts"))), "OUTSIDE_SESSION")
    )
    return rows.withColumn("rule", rule).drop("open_ts", "close_ts")


# --- appending and merging -----------------------------------------------------

def append_idempotent(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``outcome`` to the incoming rows: APPENDED, DUPLICATE_NOOP or CONFLICT.

    The first incoming row of an id, by ``order`` and then by content, is judged against the store, the
    others against it. An id stored with two contents is a conflict.
    """
    columns = existing.columns
    known = existing.groupBy(key).agg(
        F.min(content_hash(columns)).alias("_known"), F.max(content_hash(columns)).alias("_other")
    )
    rows = incoming.withColumn("_new", content_hash(columns)).withColumn("_place", F.struct(*order, "_new"))
    # Exact repeats at one place: all but one of them are no-ops. They are counted and told apart by number.
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    rows = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    first = rows.groupBy(key).agg(F.min("_place").alias("_first"))
    judged = attach(rows, first.join(known, key, "left"), [key])
    leads = (F.col("_place") == F.col("_first")) & (F.col("_copy") == 1)
    wanted = F.coalesce("_known", F.col("_first._new"))
    return judged.withColumn(
        "outcome",
        F.when(F.col("_known") != F.col("_other"), "CONFLICT")
        .when(F.col("_known").isNull() & leads, "APPENDED")
        .when(F.col("_new") == wanted, "DUPLICATE_NOOP")
        .otherwise("CONFLICT"),
    ).drop("_known", "_other", "_new", "_place", "_copy", "_first")


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows, once each, that are not present on all columns.

    Rows match on a digest of all columns, blanks and NULLs alike; the anti-join
    is on the digest alone, so no column value can be hot.
    """
    fresh = row_digests(incoming, existing.columns).dropDuplicates(["_row"])
    seen = row_digests(existing, existing.columns).select("_row").distinct()
    return fresh.join(seen, "_row", "left_anti").drop("_row")


def row_digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` and ``_row``, a digest of all of them, blanks and NULLs alike."""
    blanks = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(*columns, F.sha2(F.to_json(F.array(*blanks)), 256).alias("_row"))


def merge_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows as they are, duplicates included, plus the new ones."""
    return existing.unionByName(new_rows(existing, incoming))


def identity_conflicts(existing: DataFrame, incoming: DataFrame, key: str = "index_event_id") -> DataFrame:
    """Ids that would carry more than one content after a merge."""
    columns = existing.columns
    both = existing.unionByName(incoming.select(*columns))
    hashed = both.filter(text(F.col(key)).isNotNull()).select(key, content_hash(columns).alias("_h"))
    spread = hashed.groupBy(key).agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    return spread.filter(F.col("_a") != F.col("_b")).select(key)


def discovered_only(index_rows: DataFrame) -> DataFrame:
    return index_rows.filter(F.col("processing_status") == "DISCOVERED")


def set_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids missing from ``found`` and ids it has in excess."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = found.select(key).distinct().withColumn("_f", F.lit(True))
    side = F.when(F.col("_f").isNull(), "MISSING").when(F.col("_e").isNull(), "EXTRA")
    return left.join(right, key, "full_outer").withColumn("side", side).filter(
        F.col("side").isNotNull()
    ).select(key, "side")


# --- message index, evidence and batches --------------------------------------

def events_per_message(events: DataFrame) -> DataFrame:
    return events.groupBy("source_message_id").agg(F.count(F.lit(1)).alias("events"))


def linkage_violations(events: DataFrame, index: DataFrame, order: Sequence[str]) -> DataFrame:
    """Messages whose events disagree with their latest index row."""
    latest = latest_per_key(index, "source_message_id", order).select(
        "source_message_id", "processing_status", "normalized_event_count"
    )
    joined = events_per_message(events).join(latest, "source_message_id", "left")
    settled = F.upper("processing_status").isin("COMMITTED", "ANCHOR_EVIDENCE")
    rule = F.when(~F.coalesce(settled, F.lit(False)), "NO_COMMITTED_STATE").when(
        F.col("normalized_event_count") != F.col("events"), "EVENT_COUNT_DIFFERS"
    )
    return joined.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(
        "source_message_id", "rule", "events", "normalized_event_count"
    )


def unresolved(quarantine: DataFrame, order: Sequence[str]) -> DataFrame:
    latest = latest_per_key(quarantine, "source_message_id", order)
    status = F.upper(F.trim(F.coalesce("resolution_status", F.lit(""))))
    return latest.filter(~status.isin(*RESOLVED))


def first_offenders(offenders: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """The first few offenders for a message; a take-ordered, not a collected list."""
    return offenders.select(key).distinct().orderBy(key).limit(limit)


def evidence_problems(
    expected: DataFrame, index: DataFrame, order: Sequence[str], bootstrap_at: Column
) -> DataFrame:
    """Expected evidence ids that are absent, in the wrong status, or too late."""
    wanted = expected.select("source_message_id").distinct()
    latest = latest_per_key(index, "source_message_id", order).select(
        "source_message_id", "processing_status", "message_received_at"
    )
    rule = (
        F.when(F.col("processing_status").isNull(), "MISSING")
        .when(F.upper("processing_status") != "ANCHOR_EVIDENCE", "WRONG_STATUS")
        .when(F.col("message_received_at") > bootstrap_at, "AFTER_BOOTSTRAP")
    )
    return wanted.join(latest, "source_message_id", "left").withColumn("rule", rule).filter(
        F.col("rule").isNotNull()
    ).select("source_message_id", "rule")


def anchor_rules(anchors: DataFrame, expected_at: Column, mode: str, **limits) -> DataFrame:
    """Adds ``rule`` to anchor rows; duplicates of (account, ticker) are counted, not collected."""
    source = {"EXACT_USER_ANCHOR": "user_chat", "VERIFIED_POSITION_ANCHOR": "gmail_full_mailbox_verification"}[mode]
    keys = ["account_ref", "ticker"]
    keyed = anchors.withColumn("account_ref", F.coalesce(text(F.col("account_ref")), F.lit("DEFAULT"))).withColumn(
        "ticker", F.upper(F.trim("ticker"))
    )
    copies = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    rule = (
        F.when(~F.coalesce(F.col("anchor_at") == expected_at, F.lit(False)), "ANCHOR_TIME_DIFFERS")
        .when(~valid_ticker(F.col("ticker")), "BAD_TICKER")
        .when(~F.coalesce(F.col("shares") > 0, F.lit(False)), "BAD_SHARES")
        .when(~F.col("source").eqNullSafe(source), "BAD_SOURCE")
        .when(F.lit(mode == "EXACT_USER_ANCHOR") & F.col("avg_cost").isNull(), "COST_REQUIRED")
        .when(F.col("avg_cost") <= 0, "BAD_COST")
        .when(F.col("_copies") > 1, "DUPLICATE_POSITION")
        .when(F.col("entry_date").isNull(), "BAD_ENTRY_DATE")
    )
    return attach(keyed, copies, keys, **limits).withColumn("rule", rule).drop("_copies")


def batch_rules() -> Column:
    """Contract of a scan batch row; NULL when it holds."""
    scan = F.col("scan")
    ids_ok = reduce(
        lambda a, b: a & b,
        [valid_event_id(F.col(c)) for c in ("run_id", "batch_id", "expected_parent_transaction_id")],
    )
    ordered = (scan["window_start"] <= scan["started_at"]) & (scan["started_at"] <= scan["completed_at"])
    return (
        F.when(~F.col("schema_version").eqNullSafe(1), "SCHEMA_VERSION")
        .when(~ids_ok, "BAD_ID")
        .when(~valid_email(F.lower(F.trim("target_account"))), "BAD_ACCOUNT")
        .when(~F.coalesce(ordered, F.lit(False)), "SCAN_TIMES_OUT_OF_ORDER")
        .when(scan["pagination_complete"].isNull(), "PAGINATION_FLAG_MISSING")
        .when(~F.coalesce(scan["pages_fetched"] >= 1, F.lit(False)), "NO_PAGES")
        .when(text(scan["history_id_before"]).isNull() | text(scan["history_id_after"]).isNull(), "NO_HISTORY_ID")
        .when(F.col("messages").isNull(), "NO_MESSAGES")
    )


def message_rows(batches: DataFrame) -> DataFrame:
    """One row per message with the batch fields it inherits."""
    scan = F.col("scan")
    return batches.select(
        "batch_id",
        F.lower("target_account").alias("source_account"),
        scan["started_at"].alias("scan_started_at"),
        scan["completed_at"].alias("scan_completed_at"),
        F.posexplode("messages").alias("message_pos", "m"),
    ).select(
        "batch_id", "source_account", "scan_completed_at", "message_pos", "m.*",
        F.coalesce(F.col("m.discovered_at"), "scan_started_at").alias("discovered"),
        F.coalesce(F.col("m.processed_at"), "scan_completed_at").alias("processed"),
    ).drop("discovered_at", "processed_at").withColumnsRenamed(
        {"discovered": "discovered_at", "processed": "processed_at"}
    )


def message_rules(messages: DataFrame, **limits) -> DataFrame:
    """Adds ``rule`` to message rows; ids repeated in a batch are counted, not collected."""
    keys = ["batch_id", "source_message_id"]
    copies = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    status = F.upper(F.trim("processing_status"))
    n = F.size(F.coalesce("events", F.array().cast(messages.schema["events"].dataType)))
    verified = [text(F.col(c)).isNull() for c in ("sender", "subject", "content_hash", "parser_version", "lifecycle_type")]
    late = F.exists(
        "events",
        lambda e: F.coalesce(F.lower(e["affects_position"]).isin("true", "1", "yes"), F.lit(False))
        & (e["trade_time"] > F.col("scan_completed_at")),
    )
    rule = (
        F.when(text(F.col("source_message_id")).isNull() | (F.col("_copies") > 1), "MISSING_OR_DUPLICATE_ID")
        .when(
            (F.col("message_received_at") > F.col("scan_completed_at"))
            | (F.col("discovered_at") > F.col("processed_at")),
            "TIMES_OUT_OF_ORDER",
        )
        .when(~F.coalesce(status.isin(*FINAL_STATUSES), F.lit(False)), "BAD_STATUS")
        .when(reduce(lambda a, b: a | b, verified), "METADATA_MISSING")
        .when((status == "COMMITTED") & (n == 0), "COMMITTED_WITHOUT_EVENTS")
        .when((status != "COMMITTED") & (n > 0), "EVENTS_WITHOUT_COMMIT")
        .when((status == "QUARANTINED") & F.col("quarantine").isNull(), "QUARANTINED_WITHOUT_RECORD")
        .when(F.coalesce(late, F.lit(False)), "EVENT_AFTER_SCAN")
    )
    return attach(messages, copies, keys, **limits).withColumn("rule", rule).drop("_copies")


def flatten_events(messages: DataFrame) -> DataFrame:
    """0..n event rows per message, carrying the message's metadata."""
    return messages.select(
        "source_account", "source_message_id", "source_thread_id", "message_received_at", "sender",
        "subject", "content_hash", "parser_version", F.col("processed_at").alias("parsed_at"),
        F.explode("events").alias("_e"),
    ).select("*", "_e.*").drop("_e")


def flatten_quarantine(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("quarantine").isNotNull()).select(
        "source_account", "source_message_id", "source_thread_id", "message_received_at", "sender",
        "subject", F.col("processed_at").alias("parsed_at"), "quarantine.*",
    )


def flatten_index(messages: DataFrame) -> DataFrame:
    """Exactly two index rows per message: discovered, then its final status."""
    status = F.upper(F.trim("processing_status"))
    steps = F.array(
        F.struct(F.lit("DISCOVERED").alias("status"), F.col("discovered_at").alias("at")),
        F.struct(status.alias("status"), F.col("processed_at").alias("at")),
    )
    return messages.withColumn("_s", F.explode(steps)).select(
        stable_index_id(F.col("batch_id"), F.col("source_message_id"), F.col("_s.status")).alias("index_event_id"),
        "batch_id", "source_account", "source_message_id", "source_thread_id", "message_received_at",
        "sender", "subject", "content_hash", "parser_version",
        F.upper(F.trim("lifecycle_type")).alias("lifecycle_type"),
        F.size("events").alias("normalized_event_count"),
        F.col("_s.status").alias("processing_status"),
        F.col("_s.at").alias("processed_at"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def batch_gate(batches: DataFrame, messages: DataFrame, ledger_unresolved: DataFrame | None = None) -> DataFrame:
    """SUCCESS or BLOCKED per batch with the sorted reasons; a blocked batch keeps its waterline."""
    status = F.upper(F.trim(F.coalesce(F.col("quarantine.resolution_status"), F.lit(""))))
    open_ = messages.filter(F.col("quarantine").isNotNull() & ~status.isin(*RESOLVED))
    counts = open_.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_open"))
    rows = batches.join(counts, "batch_id", "left")
    scan = F.col("scan")
    whole = F.lit(False)
    if ledger_unresolved is not None:
        whole = ledger_unresolved.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    reasons = F.array(
        F.when(~scan["pagination_complete"], "pagination_incomplete"),
        F.when(text(scan["terminal_next_page_token"]).isNotNull(), "terminal_next_page_token_not_empty"),
        F.when(F.col("_open") > 0, "unresolved_quarantine_in_batch"),
        F.when((F.col("_open") > 0) | whole, "unresolved_quarantine"),
    )
    blocked = F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))
    return rows.withColumn("reasons", blocked).select(
        "batch_id",
        F.when(F.size("reasons") > 0, "BLOCKED").otherwise("SUCCESS").alias("commit_status"),
        F.concat_ws(",", "reasons").alias("blocked_reasons"),
        scan["history_id_before"].alias("waterline_before"),
        F.when(F.size("reasons") > 0, scan["history_id_before"]).otherwise(scan["history_id_after"]).alias("waterline_after"),
    )


def waterline_rules(scans: DataFrame, order: Sequence[str], key: str = "target_account", **limits) -> DataFrame:
    """Adds ``rule``: each scan must start at the cursor that the last accepted one left.

    A refused scan leaves no trace. A ``blocked`` one (an optional column) becomes the parent of the next but leaves the
    waterline and the time of the last scan where they were. Accepted scans are a chain: the
    successor of each is the first later scan that names it and fits its cursor. ``scan_no`` counts from 1.
    """
    digits = r"^\d+$"
    a, b = F.col("history_id_before"), F.col("history_id_after")
    backwards = F.coalesce(
        a.rlike(digits) & b.rlike(digits) & (b.try_cast("decimal(38,0)") < a.try_cast("decimal(38,0)")), F.lit(False)
    )
    blocked = F.coalesce(F.col("blocked"), F.lit(False)) if "blocked" in scans.columns else F.lit(False)
    rows = staged(
        scans.withColumns({"_node": F.struct(key, "scan_no"), "_blocked": blocked, "_backwards": backwards}), "scans"
    )
    # The time of the last unblocked scan, which a blocked one takes over from its parents.
    parents = rows.select(F.col(key), F.col("transaction_id").alias("expected_parent"), F.col("_node").alias("next"))
    held = rows.filter("_blocked").join(parents, [key, "expected_parent"]).select(F.col("_node").alias("node"), "next")
    times = rows.filter("not _blocked").select(F.col("_node").alias("end"), F.col("completed_at").alias("_held_at"))
    since = ends(held).join(times, "end").select(F.col("node").alias("_node"), "_held_at")
    state = rows.join(since, "_node", "left").select(
        "*",
        F.when(F.col("_blocked"), a).otherwise(b).alias("_left_id"),
        F.when(F.col("_blocked"), F.col("_held_at")).otherwise(F.col("completed_at")).alias("_left_at"),
    )
    state = staged(state.drop("_held_at"), "scan-cursors")
    now = state.select(key, F.col("_node").alias("node"), F.col("scan_no").alias("_no"), F.col("transaction_id").alias("expected_parent"), "_left_id", "_left_at")
    after = rows.filter("not _backwards").select(key, "expected_parent", "scan_no", "history_id_before", "completed_at")
    follows = now.join(after, [key, "expected_parent"]).filter(
        (F.col("scan_no") > F.col("_no"))
        & (F.col("_left_id").isNull() | a.eqNullSafe(F.col("_left_id")))
        & ~F.coalesce(F.col("completed_at") < F.col("_left_at"), F.lit(False))
    )
    links = follows.groupBy("node").agg(F.struct(F.first(key).alias(key), F.min("scan_no").alias("scan_no")).alias("next"))
    heads = rows.filter("not _backwards").groupBy(key).agg(F.min("scan_no").alias("scan_no"))
    accepted = walk(links, heads.select(F.struct(key, "scan_no").alias("node")))
    accepted = accepted.select(F.col("node").alias("_node"), F.lit(True).alias("_in"))
    judged = staged(state.join(accepted, "_node", "left"), "accepted-scans")

    chunked = with_chunks(judged, Order((key,), "scan_no", "scan_no", width=1 << 16), **limits)
    prior = F.when(F.col("_in"), F.struct("transaction_id", "_left_id", "_left_at"))
    ordered = Order((key,), "scan_no", "scan_no", width=1 << 16)
    judged = drop_chunks(running(chunked, ordered, {"_prev": ("last", prior, False)}))
    prev = F.col("_prev")
    rule = (
        F.when(F.col("_in"), None)
        .when(prev.isNotNull() & ~F.col("expected_parent").eqNullSafe(prev["transaction_id"]), "STALE_PARENT")
        .when(prev["_left_id"].isNotNull() & ~a.eqNullSafe(prev["_left_id"]), "WATERLINE_DIFFERS")
        .when(F.col("_backwards"), "WATERLINE_BACKWARDS")
        .when(F.col("completed_at") < prev["_left_at"], "SCAN_BACKWARDS")
    )
    return judged.select(*scans.columns, rule.alias("rule"))


def signature_of(df: DataFrame) -> Column:
    return event_signature(df.columns)


def overlay_rules(rows: DataFrame, allowed: Sequence[str], **limits) -> DataFrame:
    """Adds ``rule`` to sparse overlay rows; fields not supplied stay NULL."""
    unknown = sorted(set(rows.columns) - set(allowed) - {"correction_id", "corrected_at", "source", "ticker"})
    keys = ["correction_id", "ticker"]
    keyed = rows.withColumn("ticker", F.upper(F.trim("ticker")))
    copies = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))

    def bad_number(name: str, positive: bool) -> Column:
        raw = known_text(F.col(name))
        value = raw.try_cast("decimal(38,8)")
        wrong = value.isNull() | (value <= 0) if positive else value.isNull()
        return raw.isNotNull() & wrong

    positive = [c for c in ("shares", "avg_cost", "last_price", "market_value") if c in rows.columns]
    plain = [c for c in ("portfolio_weight_pct", "target_allocation_pct", "max_allocation_pct", "stop_loss_pct", "trim_profit_pct") if c in rows.columns]
    wrong = [bad_number(c, True) for c in positive] + [bad_number(c, False) for c in plain]
    rule = (
        F.when(F.lit(bool(unknown)), "UNKNOWN_FIELDS")
        .when(~valid_event_id(F.col("correction_id")), "BAD_ID")
        .when(~F.col("source").eqNullSafe("user_chat"), "BAD_SOURCE")
        .when(~valid_ticker(F.col("ticker")), "BAD_TICKER")
        .when(F.col("_copies") > 1, "DUPLICATE_TICKER")
        .when(reduce(lambda a, b: a | b, wrong, F.lit(False)), "BAD_NUMBER")
    )
    return attach(keyed, copies, keys, **limits).withColumn("rule", rule).drop("_copies")
