"""Replaying append-only event logs: candidate funnel and decision outbox.

Validators return violations instead of raising; only the first violation of a
key is meaningful, because later events are judged against a tainted state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portledger.operators.scans import DAY, Order, drop_chunks, running, with_chunks

# The candidate states and the moves allowed between them.
TRANSITIONS = {
    "RESEARCH_QUEUE": ("WATCHING", "PAUSED", "REMOVED"),
    "WATCHING": ("RESEARCH_QUEUE", "NEAR_TRIGGER", "PAUSED", "REMOVED"),
    "NEAR_TRIGGER": ("WATCHING", "OPEN_CANDIDATE", "PAUSED", "REMOVED"),
    "OPEN_CANDIDATE": ("NEAR_TRIGGER", "WATCHING", "PAUSED", "REMOVED"),
    "PAUSED": ("RESEARCH_QUEUE", "WATCHING", "NEAR_TRIGGER", "REMOVED"),
    "REMOVED": ("RESEARCH_QUEUE",),
}
STATES = tuple(TRANSITIONS)
STATE_EVENTS = ("CANDIDATE_ADDED", "STATE_CHANGED")
CANDIDATE_EVENTS = STATE_EVENTS + (
    "CANDIDATE_REVIEWED", "CANDIDATE_EMAIL_SENT", "CANDIDATE_EMAIL_FAILED",
    "CANDIDATE_OUTCOME_UPDATED",
)
MAX_ACTIVE = 5


def log_order(key: str, width: int = DAY) -> Order:
    """Ledger order of a log: ``pos`` then ``seq``."""
    return Order((key,), "pos", "seq", width)


def _allowed_edge(current: Column, new: Column) -> Column:
    pairs = [F.lit(f"{a}>{b}") for a, targets in TRANSITIONS.items() for b in targets]
    return F.array_contains(F.array(*pairs), F.concat_ws(">", current, new))


def candidate_states(log: DataFrame, **limits) -> DataFrame:
    """Adds the state and the latest time before each event of a ticker's log."""
    order = log_order("ticker")
    sets = F.col("event_type").isin(*STATE_EVENTS)
    return drop_chunks(
        running(
            with_chunks(log, order, **limits),
            order,
            {
                "current_state": ("last", F.when(sets, F.col("new_state")), False),
                "latest_before": ("max", F.col("occurred_at"), False),
            },
        )
    )


def candidate_rules(rows: DataFrame) -> DataFrame:
    """Adds ``rule``: the rule an event breaks, NULL when it is legal."""
    kind, current = F.col("event_type"), F.col("current_state")
    previous, new = F.col("previous_state"), F.col("new_state")
    added, changed = kind == "CANDIDATE_ADDED", kind == "STATE_CHANGED"
    rule = (
        F.when(F.col("occurred_at") < F.col("latest_before"), "TIME_OUT_OF_ORDER")
        .when(added & current.isNotNull(), "ALREADY_EXISTS")
        .when(added & previous.isNotNull(), "ADDED_WITH_PREVIOUS")
        .when(~added & current.isNull(), "NO_SUCH_CANDIDATE")
        .when(changed & ~previous.eqNullSafe(current), "PREVIOUS_STATE_MISMATCH")
        .when(changed & (new == current), "SAME_STATE")
        .when(changed & ~_allowed_edge(current, new), "ILLEGAL_TRANSITION")
        .when(~added & ~changed & previous.isNotNull() & (previous != current), "PREVIOUS_STATE_MISMATCH")
        .when(~added & ~changed & new.isNotNull() & (new != current), "STATE_CHANGED_BY_OTHER_EVENT")
    )
    return rows.withColumn("rule", rule)


def candidate_violations(log: DataFrame, **limits) -> DataFrame:
    """First broken rule per ticker: a grouped minimum over the ordered events."""
    rows = candidate_rules(candidate_states(log, **limits)).filter(F.col("rule").isNotNull())
    return rows.groupBy("ticker").agg(
        F.min_by(
            F.struct("rule", F.col("event_id").alias("detail"), "seq"), F.struct("pos", "seq")
        ).alias("_v")
    ).select("ticker", "_v.*")


def candidate_final(log: DataFrame) -> DataFrame:
    """Final state per ticker: the last state-setting event, a grouped maximum."""
    return (
        log.filter(F.col("event_type").isin(*STATE_EVENTS))
        .groupBy("ticker")
        .agg(F.max_by("new_state", F.struct("pos", "seq")).alias("state"))
    )


def ledger_vs_watchlist(states: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Differences between the replayed states and a watchlist table, full outer."""
    left = states.select("ticker", F.col("state").alias("log_state"))
    right = watchlist.groupBy("ticker").agg(
        F.min("state").alias("table_state"), F.count(F.lit(1)).alias("copies")
    )
    both = left.join(right, "ticker", "full_outer")
    problem = (
        F.when(F.col("copies") > 1, "DUPLICATE_TICKER")
        .when(F.col("table_state").isNotNull() & ~F.col("log_state").eqNullSafe(F.col("table_state")), "STATE_DIFFERS")
        .when(F.col("table_state").isNull() & (F.col("log_state") != "REMOVED"), "MISSING_FROM_TABLE")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("copies")


def active_gate(states: DataFrame, limit: int = MAX_ACTIVE) -> DataFrame:
    """One row: how many candidates are active in the log, and is that too many."""
    return states.agg(F.count_if(F.col("state") != "REMOVED").alias("active")).withColumn(
        "too_many", F.col("active") > limit
    )


EMAIL_EVENTS = ("EMAIL_SEND_INTENT", "EMAIL_SENT", "EMAIL_FAILED")


def decision_history(log: DataFrame, **limits) -> DataFrame:
    """Adds what came before each event of a decision: counts, latest time, intent marker."""
    order = log_order("decision_id")

    def count(kind: str) -> tuple[str, Column, bool]:
        return ("sum", F.when(F.col("event_type") == kind, 1).otherwise(0).cast("long"), False)

    marker = F.when(F.col("event_type") == "EMAIL_SEND_INTENT", F.col("marker"))
    return drop_chunks(
        running(
            with_chunks(log, order, **limits),
            order,
            {
                "created_before": count("DECISION_CREATED"),
                "intents_before": count("EMAIL_SEND_INTENT"),
                "sent_before": count("EMAIL_SENT"),
                "latest_before": ("max", F.col("occurred_at"), False),
                "intent_marker": ("last", marker, False),
            },
        )
    )


def decision_rules(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    created, intents, sent = (
        F.coalesce(c, F.lit(0)) for c in ("created_before", "intents_before", "sent_before")
    )
    email = kind.isin(*EMAIL_EVENTS)
    intent = kind == "EMAIL_SEND_INTENT"

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    rule = (
        F.when((kind == "DECISION_CREATED") & (created > 0), "CREATED_TWICE")
        .when(kind == "DECISION_CREATED", None)
        .when(created != 1, "NOT_CREATED_FIRST")
        .when(F.col("occurred_at") < F.col("latest_before"), "TIME_OUT_OF_ORDER")
        .when(email & blank("marker"), "MARKER_MISSING")
        .when(intent & ((intents > 0) | (sent > 0)), "SECOND_INTENT")
        .when(intent & blank("recipient"), "RECIPIENT_MISSING")
        .when(intent & blank("subject"), "SUBJECT_MISSING")
        .when(email & ~intent & (intents != 1), "NO_SINGLE_INTENT")
        .when(email & ~intent & ~F.col("marker").eqNullSafe(F.col("intent_marker")), "MARKER_DIFFERS")
        .when((kind == "EMAIL_SENT") & (sent > 0), "SENT_TWICE")
        .when((kind == "EMAIL_SENT") & blank("message_id"), "MESSAGE_ID_MISSING")
        .when((kind == "EMAIL_FAILED") & (sent > 0), "FAILED_AFTER_SENT")
        .when((kind == "EMAIL_FAILED") & blank("error"), "ERROR_MISSING")
    )
    return rows.withColumn("rule", rule)


def decision_violations(log: DataFrame, **limits) -> DataFrame:
    rows = decision_rules(decision_history(log, **limits)).filter(F.col("rule").isNotNull())
    return rows.groupBy("decision_id").agg(
        F.min_by(F.struct("rule", F.col("event_id").alias("detail"), "seq"), F.struct("pos", "seq")).alias("_v")
    ).select("decision_id", "_v.*")


def time_order_violations(log: DataFrame, key: str, **limits) -> DataFrame:
    """Events earlier than an event before them in ledger order."""
    order = Order((key,), "seq", "seq", width=1 << 20)
    rows = running(
        with_chunks(log, order, **limits), order, {"latest_before": ("max", F.col("occurred_at"), False)}
    )
    return drop_chunks(rows).filter(F.col("occurred_at") < F.col("latest_before"))
