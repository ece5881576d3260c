"""Hand cases of the rule tables: candidate log, calendar gate, outcome lookups, ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from portledger.functions import columns as c
from portledger.operators import audit, calendars, eventlog, ledger, outcomes as o, overlay
from portledger.session import shared_dir
from portledger.sources.writers import GateClosed, require_clean


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("limits", [{}, {"limit": 1}])
def test_candidate_log_reports_the_first_broken_rule(spark, limits):
    rows = [
        ("e1", "AAA", "CANDIDATE_ADDED", at("2026-01-01"), None, "RESEARCH_QUEUE", 1),
        ("e2", "AAA", "STATE_CHANGED", at("2026-01-02"), "RESEARCH_QUEUE", "OPEN_CANDIDATE", 2),
        ("e3", "BBB", "STATE_CHANGED", at("2026-01-01"), None, "WATCHING", 3),
        ("e4", "CCC", "CANDIDATE_ADDED", at("2026-01-02"), None, "WATCHING", 4),
        ("e5", "CCC", "CANDIDATE_REVIEWED", at("2026-01-01"), None, None, 5),
    ]
    log = spark.createDataFrame(
        rows, "event_id string, ticker string, event_type string, occurred_at timestamp, previous_state string, new_state string, seq long"
    ).withColumn("pos", F.col("seq"))
    found = {r.ticker: r.rule for r in eventlog.candidate_violations(log, **limits).collect()}
    assert found == {"AAA": "ILLEGAL_TRANSITION", "BBB": "NO_SUCH_CANDIDATE", "CCC": "TIME_OUT_OF_ORDER"}


def test_gate_stops_on_violations(spark):
    with pytest.raises(GateClosed):
        require_clean(spark.createDataFrame([("r",)], "rule string"))
    require_clean(spark.createDataFrame([], "rule string"))


def test_calendar_gate_priority(spark):
    days = spark.createDataFrame([(dt.date(2026, 7, 16),), (dt.date(2026, 7, 17),), (dt.date(2026, 7, 20),)], "session_date date")
    calendar = calendars.number_sessions(days, open_hour=13.5, close_hour=20.0)
    instants = spark.createDataFrame(
        [(t,) for t in map(at, ("2026-07-17T13:35:00", "2026-07-17T20:46:00", "2026-07-16T20:46:00", "2026-07-18T13:35:00", "2026-07-17T15:00:00"))],
        "ts timestamp",
    )
    daily = calendars.classify_instants(instants, calendar, at="ts", mode="intraday")
    reasons = {str(r.ts)[5:16]: r.skip_reason for r in daily.collect()}
    assert reasons["07-17 13:35"] is None
    assert reasons["07-18 13:35"] == "SKIP_NON_SESSION"
    assert reasons["07-17 15:00"] == "SKIP_OUTSIDE_SCHEDULED_WINDOW"
    weekly = calendars.classify_instants(instants, calendar, at="ts", mode="weekly-review")
    reasons = {str(r.ts)[5:16]: r.skip_reason for r in weekly.collect()}
    assert reasons["07-17 20:46"] is None and reasons["07-16 20:46"] == "SKIP_CADENCE_NOT_DUE"


@pytest.mark.parametrize("limits", [{}, {"limit": 1}])
def test_nearest_minute_prefers_the_later_of_two_equal_gaps(spark, limits):
    bars = spark.createDataFrame(
        [("T", at("2026-07-16T15:20:00"), "INTRADAY", 1.0, "f"), ("T", at("2026-07-16T15:40:00"), "INTRADAY", 2.0, "f"),
         ("U", at("2026-07-16T15:46:00"), "INTRADAY", 3.0, "f")],
        "ticker string, price_at timestamp, bar_type string, close double, source string",
    )
    rows = spark.createDataFrame(
        [("d1", "T", at("2026-07-16T15:30:00")), ("d2", "U", at("2026-07-16T15:30:00"))],
        "decision_id string, ticker string, target timestamp",
    )
    got = {r.decision_id: r.nearest for r in o.asof_nearest(rows, bars, "target", **limits).collect()}
    assert got["d1"].close == 2.0 and got["d2"] is None


def test_merge_keeps_old_duplicates_and_adds_new_rows_once(spark):
    old = spark.createDataFrame([("a", None), ("a", None)], "k string, v string")
    new = spark.createDataFrame([("a", ""), ("b", "1"), ("b", "1")], "k string, v string")
    assert sorted((r.k, r.v) for r in ledger.merge_rows(old, new).collect() if r.v) == [("b", "1")]
    assert ledger.merge_rows(old, new).count() == 3


def test_naive_times_are_missing(spark):
    df = spark.createDataFrame([("2026-07-16T09:31:00-04:00",), ("2026-07-16T09:31:00",), ("x",)], "t string")
    got = [r.p for r in df.select(F.unix_seconds(c.parse_aware_time(F.col("t"))).alias("p")).collect()]
    assert got == [1784208660, None, None]


def test_append_judges_repeats_inside_the_incoming_rows(spark):
    schema = "id string, v int"
    stored = spark.createDataFrame([("a", 1), ("x", 1), ("x", 2)], schema)
    incoming = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 5), ("c", 5), ("x", 1)], schema)
    out = ledger.append_idempotent(stored, incoming, "id").collect()
    seen = sorted((r.id, r.outcome) for r in out)
    assert seen == [
        ("a", "CONFLICT"), ("a", "DUPLICATE_NOOP"), ("b", "APPENDED"), ("b", "CONFLICT"),
        ("c", "APPENDED"), ("c", "DUPLICATE_NOOP"), ("x", "CONFLICT"),
    ]


def test_refused_overlay_leaves_no_trace(spark):
    rows = [("A", 1, "c1", "p", 10, None), ("A", 2, "c2", "p", 9, "c1"), ("A", 3, "c3", "p", 20, "c1"), ("A", 4, "c4", "p", 30, "c2"), ("A", 5, "c3", "p", 20, "c1"), ("A", 6, "c3", "q", 20, "c1")]
    frame = spark.createDataFrame(rows, "account_ref string, seq long, correction_id string, content string, corrected_at long, expected_previous string")
    out = {r.seq: r.status for r in overlay.overlay_chain(frame).collect()}
    assert out == {1: "COMMIT", 2: "NOT_LATER", 3: "COMMIT", 4: "PREVIOUS_DIFFERS", 5: "DUPLICATE_NOOP", 6: "ID_REUSED"}


def test_refused_scan_leaves_no_trace(spark):
    rows = [("M", 1, "t1", None, "0", "10", 1, False), ("M", 2, "t2", "t1", "10", "5", 2, False), ("M", 3, "t3", "t1", "10", "20", 3, True), ("M", 4, "t4", "t3", "20", "30", 4, False), ("M", 5, "t5", "t3", "10", "30", 5, False)]
    frame = spark.createDataFrame(rows, "target_account string, scan_no long, transaction_id string, expected_parent string, history_id_before string, history_id_after string, completed_at long, blocked boolean")
    out = {r.scan_no: r.rule for r in ledger.waterline_rules(frame, ["scan_no"]).collect()}
    assert out == {1: None, 2: "WATERLINE_BACKWARDS", 3: None, 4: "WATERLINE_DIFFERS", 5: None}


def test_long_generation_chains_are_walked(spark):
    rows = [(f"g{i}", f"g{i - 1}", f"h{i - 1}", f"h{i}", f"b{i}") for i in range(150)]
    frame = spark.createDataFrame(rows, "transaction_id string, parent_id string, parent_hash string, content_hash string, batch_id string")
    heads = spark.createDataFrame([("g149",)], "transaction_id string")
    out = audit.generation_chain(frame, heads).collect()
    assert sorted(r.hops for r in out) == list(range(150))
    with pytest.raises(GateClosed):
        audit.generation_chain(frame.union(frame.filter("transaction_id = 'g3'")), heads)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
