"""Plans that score decisions at their horizons, and the calendar gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from portledger.operators import audit, calendars, ledger, outcomes as o, paths
from portledger.plans.fixtures import (
    fx_bar_ledger,
    fx_decision_events,
    fx_event_trades,
    fx_sessions,
    table,
)
from portledger.plans.registry import plan, rounded
from portledger.session import scratch_path
from portledger.sources import writers
from portledger.sources.staging import staged

RULES = o.OutcomeRules(as_of="2024-01-30 22:00:00", zone="UTC")


def bars(spark, sf_dir):
    """Final bars visible at the cut-off; the fixture already has one per ticker and instant."""
    seen = ledger.visible_as_of(fx_bar_ledger(spark, sf_dir), RULES.now(), "bar_at", "collected_at")
    return staged(ledger.final_minutes(seen), "bars")


def trades(spark, sf_dir):
    return o.learnt_fills(fx_event_trades(spark, sf_dir), RULES)


def holdings(spark, sf_dir):
    rows = o.decision_holdings(o.decision_delivery(fx_decision_events(spark, sf_dir), RULES), RULES)
    return staged(rows, "holdings")


def matured(spark, sf_dir):
    rows = o.matured_rows(holdings(spark, sf_dir), bars(spark, sf_dir), fx_sessions(spark, sf_dir), RULES)
    return o.score(rows, RULES)


def micros(name: str):
    return F.unix_micros(name).alias(name)


@plan(
    "d6_decision_delivery",
    """SELECT decision_id, epoch_us(created_at) AS created_at, epoch_us(delivered_at) AS delivered_at, epoch_us(decision_at) AS decision_at FROM dec""",
    uses=("dec",),
)
def decision_delivery(spark, sf_dir):
    rows = o.decision_delivery(fx_decision_events(spark, sf_dir), RULES)
    return rows.select("decision_id", micros("created_at"), micros("delivered_at"), micros("decision_at"))


@plan(
    "d7_decision_holdings_horizon",
    """SELECT decision_id, ticker, action, exposure, h.horizon, CAST(h.k AS INT) AS "offset" FROM dec_h
       CROSS JOIN (VALUES ('1h', 0), ('close', 0), ('1d', 1), ('5d', 5), ('20d', 20)) h(horizon, k)""",
    uses=("dec_h",),
)
def decision_holdings_horizon(spark, sf_dir):
    return o.by_horizon(holdings(spark, sf_dir)).select(
        "decision_id", "ticker", "action", "exposure", "horizon", "offset"
    )


@plan(
    "d8_reference_minute_equi",
    """SELECT decision_id, ticker, rstat AS reference_status, CASE WHEN rstat = 'MATURED' THEN ref_raw END AS reference_price FROM refs""",
    uses=("refs",),
)
def reference_minute(spark, sf_dir):
    rows = o.with_reference(holdings(spark, sf_dir), bars(spark, sf_dir), fx_sessions(spark, sf_dir), RULES)
    return rows.select("decision_id", "ticker", "reference_status", "reference_price")


@plan(
    "d9_asof_nearest_tolerance",
    """SELECT d.decision_id, d.ticker, n.near_close, epoch_us(n.near_at) AS near_at FROM dec_h d
       LEFT JOIN near n ON n.decision_id = d.decision_id AND n.ticker = d.ticker""",
    uses=("dec_h", "near"),
)
def asof_nearest(spark, sf_dir):
    rows = holdings(spark, sf_dir).withColumn("target", F.col("decision_at") + F.expr("interval 1 hour"))
    near = o.asof_nearest(rows, bars(spark, sf_dir), "target")
    return near.select(
        "decision_id", "ticker", F.col("nearest.close").alias("near_close"),
        F.unix_micros("nearest.price_at").alias("near_at"),
    )


@plan(
    "d10_session_offset_close",
    f"""SELECT d.decision_id, d.ticker, h.horizon, CASE WHEN t.close_ts IS NULL OR TIMESTAMP '2024-01-30 22:00:00' < t.close_ts THEN 'PENDING'
               WHEN b.close IS NULL OR c.close IS NULL THEN 'PENDING_DATA' ELSE 'MATURED' END AS target_status,
               CASE WHEN TIMESTAMP '2024-01-30 22:00:00' >= t.close_ts AND b.close IS NOT NULL THEN c.close END AS target_price
        FROM dec_h d LEFT JOIN fx_sessions s ON CAST(decision_at AS DATE) = s.session_date
        CROSS JOIN (VALUES ('1h', 0), ('close', 0), ('1d', 1), ('5d', 5), ('20d', 20)) h(horizon, k)
        LEFT JOIN fx_sessions t ON t.session_idx = s.session_idx + h.k
        LEFT JOIN vis_bars b ON b.bar_type = 'DAILY_CLOSE' AND b.ticker = 'SPY' AND b.session_date = t.session_date
        LEFT JOIN vis_bars c ON c.bar_type = 'DAILY_CLOSE' AND c.ticker = d.ticker AND c.session_date = t.session_date""",
    uses=("dec_h", "fx_sessions", "vis_bars"),
)
def session_offset_close(spark, sf_dir):
    calendar = fx_sessions(spark, sf_dir)
    rows = holdings(spark, sf_dir).withColumn("session_date", F.to_date("decision_at")).join(
        F.broadcast(calendar.select("session_date", "session_idx")), "session_date", "left"
    )
    out = o.session_offset_close(o.by_horizon(rows), bars(spark, sf_dir), calendar, RULES)
    return out.select(
        "decision_id", "ticker", "horizon", "target_status", F.col("target_bar.close").alias("target_price")
    )


@plan(
    "d11_path_interval_join",
    """SELECT decision_id, ticker, horizon, round(hold_dd, 6) AS hold_max_drawdown_pct FROM hold_path""",
    uses=("hold_path",),
)
def path_interval(spark, sf_dir):
    shared, calendar = bars(spark, sf_dir), fx_sessions(spark, sf_dir)
    rows = o.matured_rows(holdings(spark, sf_dir), shared, calendar, RULES).filter(F.col("end_at").isNotNull())
    out = o.with_hold_path(staged(rows, "matured"), staged(paths.blocks(shared), "price-blocks"))
    return rounded(out.select("decision_id", "ticker", "horizon", "hold_max_drawdown_pct"))


@plan(
    "f13_path_drawdown",
    """SELECT ticker, CAST(session_date AS VARCHAR) AS session_date, count(*) AS bars, round(least(min(close / peak - 1), 0) * 100, 6) AS drawdown_pct
       FROM (SELECT *, max(close) OVER (PARTITION BY ticker, session_date ORDER BY price_at, bar_type = 'DAILY_CLOSE' ROWS UNBOUNDED PRECEDING) AS peak FROM vis_bars)
       GROUP BY 1, 2""",
    uses=("vis_bars",),
)
def path_drawdown(spark, sf_dir):
    """Each session as one stretch that starts with its first bar."""
    shared, at, key = bars(spark, sf_dir), F.unix_micros("price_at"), ["ticker", "session_date"]
    sessions = shared.groupBy(*key).agg(
        F.count(F.lit(1)).alias("bars"), F.min(at).alias("lo"), (F.max(at) + 1).alias("hi"), F.lit(1).alias("part"),
        F.lit(1.0).alias("shares"), F.lit(0.0).alias("cash"), F.lit(None).cast("double").alias("initial"),
    )
    sessions = staged(sessions, "sessions")
    falls = paths.extremes(sessions, staged(paths.blocks(shared), "price-blocks"), key)
    return rounded(
        sessions.join(falls, key).select(
            "ticker", F.col("session_date").cast("string").alias("session_date"), "bars", (F.col("worst") * 100.0).alias("drawdown_pct")
        )
    )


@plan(
    "d12_trade_interval_join",
    """SELECT decision_id, ticker, count(DISTINCT seq) AS fills, round(sum(DISTINCT dq * 1000000 + seq), 6) AS checksum
       FROM moves GROUP BY 1, 2""",
    uses=("moves",),
)
def trade_interval(spark, sf_dir):
    """Fills of each decision's longest span as differences of prefix sums at its end and its start."""
    rows = staged(matured(spark, sf_dir), "matured")
    swept = staged(o.sweep(rows, trades(spark, sf_dir), {"checksum": o.change() * 1000000 + F.col("seq")}), "swept-spans")
    key, last = list(o.KEY), F.max_by(F.struct("before", "checksum"), "pos")
    end = swept.filter("mark = 'end'").groupBy(*key).agg(last.alias("end"))
    start = swept.filter("mark = 'start'").select(*key, F.struct("before", "checksum").alias("start"))
    return start.join(end, key).select(
        *key, (F.col("end.before") - F.col("start.before")).alias("fills"),
        F.round(F.col("end.checksum") - F.col("start.checksum"), 6).alias("checksum"),
    ).filter("fills > 0")


@plan(
    "f14_replay_shares_cash",
    """SELECT decision_id, ticker, horizon, round(end_value, 4) AS end_value, round(least(worst, 0) * 100, 6) AS worst_pct
       FROM actual WHERE s0 IS NOT NULL AND flaw IS NULL AND least >= 0""",
    uses=("actual",),
)
def replay_shares_cash(spark, sf_dir):
    shared = bars(spark, sf_dir)
    rows = o.matured_rows(holdings(spark, sf_dir), shared, fx_sessions(spark, sf_dir), RULES)
    rows = staged(rows, "matured")
    known = staged(trades(spark, sf_dir), "trades")
    judged = staged(o.judge_spans(rows, known), "judged")
    fills = staged(o.replayed_fills(rows, known, judged), "fills")
    out = o.replay_values(rows, fills, staged(paths.blocks(shared), "price-blocks"), judged)
    return out.select(
        "decision_id", "ticker", "horizon", F.round("end_value", 4).alias("end_value"),
        (F.round(F.least("worst", F.lit(0.0)) * 100, 6) + 0.0).alias("worst_pct"),
    )


def scored(spark, sf_dir):
    return o.outcomes(
        fx_decision_events(spark, sf_dir), bars(spark, sf_dir), trades(spark, sf_dir),
        fx_sessions(spark, sf_dir), RULES,
    )


@plan(
    "i6_actual_vs_hold_vs_advice",
    """SELECT decision_id, ticker, horizon, action, relation, round(ref, 6) AS reference_price, round(end_price, 6) AS end_price,
              CASE WHEN stat = 'MATURED' AND (exposure IS NULL OR actual_return IS NULL) THEN 'MATURED_PARTIAL' ELSE stat END AS status,
              round(hold_return, 5) AS hold_return_pct, round(advice_return, 5) AS advice_return_pct, round(actual_return, 5) AS actual_return_pct,
              round(hold_dd, 5) AS hold_max_drawdown_pct, round(actual_dd, 5) AS actual_max_drawdown_pct, coalesce(note, '') AS actual_note
       FROM scored_outcome""",
    uses=("scored_outcome",),
)
def actual_vs_hold_vs_advice(spark, sf_dir):
    columns = ("hold_return_pct", "advice_return_pct", "actual_return_pct", "hold_max_drawdown_pct", "actual_max_drawdown_pct")
    return scored(spark, sf_dir).select(
        "decision_id", "ticker", "horizon", "action", "relation",
        F.round("reference_price", 6).alias("reference_price"), F.round("end_price", 6).alias("end_price"), "status",
        *[(F.round(c, 5) + 0.0).alias(c) for c in columns],
        F.coalesce("actual_note", F.lit("")).alias("actual_note"),
    )


@plan(
    "i6_outcome_table",
    """SELECT decision_id, ticker, strftime(decision_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS decision_at,
              CASE WHEN CAST(substr(decision_id, 2) AS BIGINT) % 4 <> 0 THEN 'REGULAR' ELSE 'UNCONFIRMED' END AS market_phase,
              action AS advice_action, relation AS user_event_relation, horizon AS outcome_horizon,
              CASE WHEN stat = 'MATURED' AND (exposure IS NULL OR actual_return IS NULL) THEN 'MATURED_PARTIAL' ELSE stat END AS outcome_status,
              round(actual_return, 4) AS actual_return_pct, coalesce(printf('%.8f', (end_price / ref - 1) * 100), '') AS hold_return_pct,
              coalesce(printf('%.8f', exposure * ((end_price / ref - 1) * 100) - abs(1 - exposure) * 10 / 100), '') AS advice_counterfactual_return_pct,
              round(actual_dd, 4) AS actual_max_drawdown_pct, coalesce(printf('%.8f', hold_dd), '') AS hold_max_drawdown_pct,
              '10.00 bps on changed exposure' AS transaction_cost_assumption, coalesce(printf('%.8f', ref), '') AS reference_price,
              coalesce(strftime(ref_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS reference_price_at, coalesce(printf('%.8f', end_price), '') AS end_price,
              coalesce(strftime(end_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS end_price_at,
              CASE WHEN end_at IS NULL THEN '' ELSE 'feed' END AS price_source, '2024-01-30T22:00:00.000000Z' AS calculated_at,
              concat_ws(';', CASE WHEN stat = 'NOT_DELIVERED' THEN 'NOT_DELIVERED' WHEN ref IS NOT NULL THEN 'FROM_FIRST_WHOLE_MINUTE'
                                  WHEN stat = 'PENDING' THEN 'REFERENCE_PENDING' ELSE 'REFERENCE_MISSING' END,
                        CASE WHEN end_at IS NOT NULL AND exposure IS NULL THEN 'EXPOSURE_MISSING' END, CASE WHEN end_at IS NOT NULL THEN note END) AS notes,
              true AS stamped
       FROM scored_outcome""",
    uses=("scored_outcome",),
)
def outcome_table(spark, sf_dir):
    """The 22 columns as written to the sink and read back; the fingerprint is held against one made anew."""
    digest = audit.fingerprint(bars(spark, sf_dir), "outcomes")
    rows = o.outcome_table(scored(spark, sf_dir), RULES, digest)
    path = scratch_path(spark, "outcome-table")
    writers.write_sorted(rows, path, "decision_at", "decision_id", "ticker", "outcome_horizon")
    rows = spark.read.schema(rows.schema).parquet(path)
    number = [(F.round(F.expr(f"try_cast({c} AS double)"), 4) + 0.0).alias(c) for c in ("actual_return_pct", "actual_max_drawdown_pct")]
    others = [c for c in rows.columns if c not in ("actual_return_pct", "actual_max_drawdown_pct", "input_sha256")]
    again = audit.fingerprint(bars(spark, sf_dir), "outcomes").select("input_sha256").scalar()
    return rows.select(*others, *number, (F.col("input_sha256") == again).alias("stamped"))


@plan(
    "j15_calendar_classify",
    """SELECT seq, is_session, in_regular AS in_regular_session, after_regular AS after_regular_session, coalesce(slot, '') AS scheduled_slot,
              CASE WHEN slot IS NULL THEN 'SKIP_OUTSIDE_SCHEDULED_WINDOW' WHEN NOT is_session THEN 'SKIP_NON_SESSION'
                   WHEN NOT after_regular THEN 'SKIP_WRONG_MARKET_PHASE' WHEN NOT due THEN 'SKIP_CADENCE_NOT_DUE' ELSE '' END AS skip_reason
       FROM (SELECT event_id AS seq, s.session_date IS NOT NULL AS is_session, coalesce(ts < s.close_ts, false) AS in_regular, coalesce(ts >= s.close_ts, false) AS after_regular,
               CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 1290 AND 1349 THEN CAST(ts AS DATE) || '-2130-ET-weekly-review'
                    WHEN hour(ts) * 60 + minute(ts) BETWEEN 600 AND 659 THEN CAST(ts AS DATE) || '-1000-ET-weekly-review' END AS slot,
               coalesce(yearweek(s.session_date) <> yearweek(s.next_session), true) AS due
             FROM events LEFT JOIN fx_sessions s ON CAST(ts AS DATE) = s.session_date)""",
    uses=("fx_sessions",),
)
def calendar_classify(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    out = calendars.classify_instants(
        events, fx_sessions(spark, sf_dir), at="ts", mode="weekly-review", slots=(600, 1290), window_minutes=60, zone="UTC"
    )
    return out.select(
        "seq", "is_session", "in_regular_session", "after_regular_session",
        F.coalesce("scheduled_slot", F.lit("")).alias("scheduled_slot"), F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
    )


@plan(
    "j15_midnight_gate",
    """SELECT seq, CASE WHEN NOT win THEN 'SKIP_OUTSIDE_SCHEDULED_WINDOW' WHEN d IS NULL THEN 'SKIP_NON_SESSION'
              WHEN ts >= close_ts THEN 'SKIP_OUTSIDE_REGULAR_SESSION' ELSE '' END AS skip_reason
       FROM (SELECT event_id AS seq, ts, s.session_date AS d, s.close_ts, hour(ts) = 16 AND minute(ts) < 15 AS win
             FROM events LEFT JOIN fx_sessions s ON CAST(ts AS DATE) = s.session_date)""",
    uses=("fx_sessions",),
)
def midnight_gate(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    out = calendars.classify_midnight(events, fx_sessions(spark, sf_dir), at="ts", zone="UTC")
    return out.select("seq", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))
