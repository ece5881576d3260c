"""Plans over broker fills, positions, logs, batches and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from portledger.operators import contracts, eventlog, ledger, overlay
from portledger.operators import positions as p
from portledger.plans.fixtures import (
    fx_anchor,
    fx_bars,
    fx_batches,
    fx_broker,
    fx_broker_fills,
    fx_corrections,
    fx_decision_log,
    fx_holdings,
    fx_messages,
    fx_overlays,
    fx_raw_minutes,
    fx_scans,
    fx_sent_bars,
    fx_sessions,
    fx_statelog,
    fx_trades,
)
from portledger.plans.registry import plan
from portledger.session import scratch_path
from portledger.sources import readers, writers
from portledger.sources.staging import staged


def fills(spark, sf_dir):
    """Prepared fills with their opening positions, staged: the replay passes over them."""
    prepared = p.prepare(fx_trades(spark, sf_dir), fx_anchor(spark, sf_dir))
    return staged(prepared, "fills")


def bare_fills(spark, sf_dir):
    return staged(p.prepare(fx_trades(spark, sf_dir)), "fills")


@plan(
    "i1_position_fold",
    """SELECT account_ref, ticker, shares, round(total_cost + 3e-5, 2) AS total_cost, round(avg_cost, 4) AS avg_cost,
              CASE WHEN realised_complete THEN round(realised_pnl + 3e-5, 2) END AS realised_pnl, realised_complete,
              true AS cost_known, false AS fees_complete, '1994-12-30' AS entry_date, applied, false AS oversold
       FROM positions""",
    uses=("positions",),
)
def position_fold(spark, sf_dir):
    out = p.fold(fills(spark, sf_dir))
    return out.select(
        "account_ref", "ticker", F.col("shares").cast("double").alias("shares"),
        F.round(F.col("total_cost") + 3e-5, 2).alias("total_cost"), F.round("avg_cost", 4).alias("avg_cost"),
        F.round(F.col("realised_pnl") + 3e-5, 2).alias("realised_pnl"), "realised_complete", "cost_known",
        "fees_complete", F.col("entry_date").cast("string").alias("entry_date"), "applied", "oversold",
    )


@plan(
    "i1_position_fold_exact",
    """SELECT account_ref, ticker, q AS shares, round(cost + 3e-5, 2) AS total_cost, round(realised + 3e-5, 2) AS realised_pnl
       FROM replay WHERE j = n""",
    uses=("replay",),
)
def position_fold_exact(spark, sf_dir):
    return p.fold_small(fills(spark, sf_dir)).select(
        "account_ref", "ticker", F.col("shares").cast("double").alias("shares"),
        F.round(F.col("total_cost").cast("double") + 3e-5, 2).alias("total_cost"),
        F.round(F.col("realised_pnl").cast("double") + 3e-5, 2).alias("realised_pnl"),
    )


@plan(
    "i1_broker_contract",
    """SELECT account_ref, seq, rule FROM ruled_fills WHERE rule IS NOT NULL""",
    uses=("ruled_fills",),
)
def broker_contract(spark, sf_dir):
    judged = p.broker_rules(fx_broker_fills(spark, sf_dir))
    return judged.filter(F.col("rule").isNotNull()).select("account_ref", "seq", "rule")


def broker_positions(spark, sf_dir):
    return p.replay(fx_broker_fills(spark, sf_dir), fx_anchor(spark, sf_dir))


@plan(
    "i1_broker_positions",
    """SELECT account_ref, ticker, coalesce(refused, 0) AS refused, first_rule, CASE WHEN fine THEN q END AS shares,
              CASE WHEN fine AND known THEN round(cost + 3e-5, 2) END AS total_cost, CASE WHEN fine AND complete THEN round(realised + 3e-5, 2) END AS realised_pnl,
              CASE WHEN fine THEN complete END AS realised_complete, CASE WHEN fine THEN known END AS cost_known,
              CASE WHEN fine THEN fees_ok END AS fees_complete, CASE WHEN fine THEN n END AS applied, CASE WHEN fine THEN company END AS company_name
       FROM broker_positions""",
    uses=("broker_positions",),
)
def broker_position_rows(spark, sf_dir):
    return broker_positions(spark, sf_dir).select(
        "account_ref", "ticker", "refused", "first_rule", F.col("shares").cast("double").alias("shares"),
        F.round(F.col("total_cost") + 3e-5, 2).alias("total_cost"), F.round(F.col("realised_pnl") + 3e-5, 2).alias("realised_pnl"),
        "realised_complete", "cost_known", "fees_complete", "applied", "company_name",
    )


@plan(
    "e3_broker_holdings",
    """SELECT ticker, sum(q) AS shares, CASE WHEN bool_and(known) THEN round(sum(cost) + 3e-5, 2) END AS total_cost, bool_and(known) AS cost_known,
              bool_and(fees_ok) AS fees_complete, count(*) AS accounts, arg_max(company, account_ref) FILTER (WHERE company IS NOT NULL) AS company_name
       FROM broker_positions WHERE fine GROUP BY 1""",
    uses=("broker_positions",),
)
def broker_holdings(spark, sf_dir):
    """Positions without a refused fill, summed by ticker; all were opened at one time, so the last account names them."""
    out = p.consolidate(broker_positions(spark, sf_dir).filter(F.col("refused") == 0))
    return out.select(
        "ticker", F.col("shares").cast("double").alias("shares"), F.round(F.col("total_cost") + 3e-5, 2).alias("total_cost"),
        "cost_known", "fees_complete", "accounts", "company_name",
    )


@plan(
    "e3_position_consolidate",
    """SELECT ticker, sum(shares) AS shares, round(sum(total_cost) + 3e-5, 2) AS total_cost,
              round(sum(total_cost) / sum(shares), 4) AS avg_cost, true AS cost_known, false AS fees_complete,
              '1994-12-30' AS entry_date, count(*) AS accounts FROM positions GROUP BY 1""",
    uses=("positions",),
)
def consolidate(spark, sf_dir):
    out = p.consolidate(p.fold(fills(spark, sf_dir)))
    return out.select(
        "ticker", F.col("shares").cast("double").alias("shares"), F.round(F.col("total_cost") + 3e-5, 2).alias("total_cost"),
        F.round("avg_cost", 4).alias("avg_cost"), "cost_known", "fees_complete",
        F.col("entry_date").cast("string").alias("entry_date"), "accounts",
    )


@plan(
    "e4_replay_audit",
    """SELECT (SELECT count(*) FROM lineitem) AS input_rows, CAST(sum(applied) AS BIGINT) AS applied,
              (SELECT count(*) FROM lineitem) - CAST(sum(applied) AS BIGINT) AS ignored,
              CASE WHEN bool_and(realised_complete) THEN round(sum(realised_pnl) + 3e-5, 2) END AS realised_pnl,
              false AS any_oversold, count(DISTINCT ticker) AS active_tickers, '' AS unknown_cost_tickers,
              (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT DISTINCT ticker FROM positions)) AS fee_incomplete_tickers
       FROM positions""",
    uses=("positions",),
)
def replay_audit(spark, sf_dir):
    out = p.replay_audit(p.fold(fills(spark, sf_dir)), fx_trades(spark, sf_dir))
    return out.withColumn("realised_pnl", F.round(F.col("realised_pnl") + 3e-5, 2))


@plan(
    "f15_oversell_first",
    """SELECT account_ref, ticker, seq, epoch(trade_time)::BIGINT AS trade_epoch, quantity, held_after - signed AS held
       FROM (SELECT *, row_number() OVER (PARTITION BY account_ref, ticker ORDER BY j) AS r
             FROM trade_rows WHERE side = 'SELL' AND held_after < 0) WHERE r = 1""",
    uses=("trade_rows",),
)
def oversell_first(spark, sf_dir):
    out = p.oversold(bare_fills(spark, sf_dir))
    return out.select(
        "account_ref", "ticker", "seq", F.unix_seconds("trade_time").alias("trade_epoch"),
        F.col("quantity").cast("double").alias("quantity"), F.col("held").cast("double").alias("held"),
    )


@plan(
    "g4_replay_order",
    """SELECT account_ref, ticker, j AS position, seq, held_after FROM trade_rows""",
    uses=("trade_rows",),
)
def replay_order(spark, sf_dir):
    """Rank and running quantity of every fill, by a chunked scan."""
    from portledger.operators.scans import running, with_chunks

    prepared = bare_fills(spark, sf_dir)
    order = p.order_of(prepared)
    out = running(
        with_chunks(prepared, order),
        order,
        {
            "position": ("sum", F.lit(1).cast("long"), True),
            "held_after": ("sum", F.col("signed"), True),
        },
    )
    return out.select(
        "account_ref", "ticker", "position", "seq", F.col("held_after").cast("double").alias("held_after")
    )


# --- event filters ---------------------------------------------------------------

def cutoff():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def anchored():
    return F.lit("2024-01-05 00:00:00").cast("timestamp")


@plan(
    "c4_visible_as_of",
    """SELECT account_ref, count(*) AS visible, sum(i)::BIGINT AS id_sum FROM fx_broker
       WHERE trade_time <= TIMESTAMP '2024-01-20' AND received <= TIMESTAMP '2024-01-20'
         AND received + INTERVAL 30 SECOND <= TIMESTAMP '2024-01-20' GROUP BY 1""",
    uses=("fx_broker",),
)
def visible(spark, sf_dir):
    seen = ledger.visible_as_of(
        fx_broker(spark, sf_dir), cutoff(), "trade_time", "message_received_at", "parsed_at"
    )
    return seen.groupBy("account_ref").agg(
        F.count(F.lit(1)).alias("visible"), F.sum("seq").alias("id_sum")
    )


@plan(
    "c5_position_affecting",
    """SELECT seq, moves, affects AND NOT moves AS violates FROM broker_pos""",
    uses=("broker_pos",),
)
def position_affecting(spark, sf_dir):
    rows = fx_broker(spark, sf_dir)
    bad = ledger.nonconforming(rows).select("seq", F.lit(True).alias("violates"))
    good = rows.select("seq", ledger.position_affecting().alias("moves"))
    return good.join(bad, "seq", "left").select(
        "seq", "moves", F.coalesce("violates", F.lit(False)).alias("violates")
    )


@plan(
    "c6_source_whitelist",
    """SELECT seq, CASE WHEN lower(trim(source_account)) <> 'investor@example.com' THEN 'OTHER_ACCOUNT'
              WHEN sender_addr <> 'trades@verified.example' THEN 'SENDER_NOT_LISTED' ELSE 'SUBJECT_NOT_CONFIRMED' END AS rule
       FROM fx_broker WHERE lower(trim(source_account)) <> 'investor@example.com' OR sender_addr <> 'trades@verified.example'
         OR NOT regexp_matches(subject, '(?i)trade filled|stock reward')""",
    uses=("fx_broker",),
)
def source_whitelist(spark, sf_dir):
    rule = ledger.source_rule(
        "investor@example.com", ["trades@verified.example"], ["trade filled", "stock reward"]
    )
    rows = fx_broker(spark, sf_dir).select("seq", rule.alias("rule"))
    return rows.filter(F.col("rule").isNotNull())


@plan(
    "c7_trade_time_consistency",
    """SELECT seq, CASE WHEN proxy AND abs(epoch_us(trade_time) - epoch_us(received)) > 1000000 THEN 'PROXY_DIFFERS_FROM_NOTIFICATION'
              WHEN NOT proxy AND epoch_us(trade_time) - epoch_us(received) > 300000000 THEN 'EXECUTED_AFTER_NOTIFICATION'
              WHEN trade_time > TIMESTAMP '2024-01-20 00:05:00' OR received > TIMESTAMP '2024-01-20 00:05:00' THEN 'FUTURE_DATED' END AS rule
       FROM fx_broker""",
    uses=("fx_broker",),
)
def trade_time_consistency(spark, sf_dir):
    return fx_broker(spark, sf_dir).select("seq", ledger.trade_time_rule(cutoff()).alias("rule"))


@plan(
    "c8_after_anchor_before_cutoff",
    """SELECT usage, count(*) AS events FROM (SELECT CASE WHEN trade_time <= TIMESTAMP '2024-01-05' THEN 'BEFORE_ANCHOR'
         WHEN trade_time > TIMESTAMP '2024-01-20' OR received > TIMESTAMP '2024-01-20' THEN 'AFTER_CUTOFF' ELSE 'APPLIED' END AS usage
         FROM fx_broker) GROUP BY 1""",
    uses=("fx_broker",),
)
def anchor_cutoff(spark, sf_dir):
    rows = ledger.after_anchor_before_cutoff(fx_broker(spark, sf_dir), anchored(), cutoff())
    return rows.groupBy("usage").agg(F.count(F.lit(1)).alias("events"))


@plan(
    "c9_later_than_correction",
    """SELECT p.seq, p.account_ref, o.correction_id FROM broker_pos p JOIN fx_overlays o ON p.account_ref = o.account_ref
       WHERE moves AND trade_time > corrected_at""",
    uses=("broker_pos", "fx_overlays"),
)
def later_than_correction(spark, sf_dir):
    events = fx_broker(spark, sf_dir).filter(ledger.position_affecting())
    later = overlay.later_than_correction(events, fx_overlays(spark, sf_dir))
    return later.select("seq", "account_ref", "correction_id")


@plan(
    "c2_final_minute_only",
    """SELECT bar_id, epoch(bar_at)::BIGINT + 60 AS price_epoch FROM fx_raw_minutes WHERE seq % 3 <> 0""",
    uses=("fx_raw_minutes",),
)
def final_minute_only(spark, sf_dir):
    early = F.when(F.col("seq") % 3 == 0, F.col("bar_at")).otherwise(F.col("collected_at"))
    bars = ledger.final_minutes(fx_raw_minutes(spark, sf_dir).withColumn("collected_at", early))
    return bars.select("bar_id", F.unix_seconds("price_at").alias("price_epoch"))


@plan(
    "c3_bar_valid_in_session",
    """SELECT rule, count(*) AS bars FROM (SELECT CASE WHEN isodow(session_date) > 5 THEN 'NOT_A_SESSION'
         WHEN collected_at > session_date + INTERVAL 21 HOUR THEN 'OUTSIDE_SESSION' ELSE 'VALID' END AS rule FROM fx_raw_minutes) GROUP BY 1""",
    uses=("fx_raw_minutes",),
)
def bar_valid_in_session(spark, sf_dir):
    rows = ledger.bar_rules(fx_raw_minutes(spark, sf_dir), fx_sessions(spark, sf_dir))
    return rows.groupBy(F.coalesce("rule", F.lit("VALID")).alias("rule")).agg(
        F.count(F.lit(1)).alias("bars")
    )


# --- first and latest rows ----------------------------------------------------------

@plan(
    "f10_latest_per_key",
    """SELECT source_message_id, seq, processing_status, content_hash FROM fx_messages
       QUALIFY row_number() OVER (PARTITION BY source_message_id ORDER BY seq DESC) = 1""",
    uses=("fx_messages",),
)
def latest_per_key(spark, sf_dir):
    rows = fx_messages(spark, sf_dir).drop("text", "normalized_event_count")
    return ledger.latest_per_key(rows, "source_message_id", ["seq"])


@plan(
    "f11_first_per_key_dedup",
    """SELECT execution_id, dedup, count(*) AS n FROM (
         SELECT execution_id, CASE WHEN r = 1 THEN 'FIRST' WHEN sig = first_value(sig) OVER (PARTITION BY execution_id ORDER BY r) THEN 'DUPLICATE' ELSE 'CONFLICT' END AS dedup
         FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY copy, l_partkey, l_suppkey, quantity, price) AS r
               FROM (SELECT *, (side, quantity, price, ticker, trade_time) AS sig
                     FROM (SELECT *, 0 AS copy FROM fx_trades UNION ALL SELECT *, 1 AS copy FROM fx_trades WHERE seq % 10 = 0))))
       GROUP BY 1, 2""",
    uses=("fx_trades",),
)
def first_per_key(spark, sf_dir):
    trades = fx_trades(spark, sf_dir).withColumn("copy", F.lit(0))
    again = trades.filter(F.col("seq") % 10 == 0).withColumn("copy", F.lit(1))
    rows = staged(trades.unionByName(again), "copies")
    signature = F.sha2(F.to_json(F.struct("side", "quantity", "price", "ticker", "trade_time")), 256)
    marked = ledger.dedup_first(
        rows, ["execution_id"], ["copy", "l_partkey", "l_suppkey", "quantity", "price"], signature
    )
    return marked.groupBy("execution_id", "dedup").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "f12_bar_dedup",
    """SELECT dedup, count(*) AS bars, sum(seq)::BIGINT AS seq_sum FROM (
         SELECT seq, CASE WHEN r = 1 THEN 'FIRST' WHEN close = first_value(close) OVER (PARTITION BY ticker, bar_at ORDER BY r) THEN 'DUPLICATE' ELSE 'CONFLICT' END AS dedup
         FROM (SELECT *, row_number() OVER (PARTITION BY ticker, bar_at ORDER BY seq) AS r
               FROM (SELECT * FROM fx_sent_bars QUALIFY row_number() OVER (PARTITION BY bar_id ORDER BY seq) = 1)
               WHERE collected_at <= TIMESTAMP '2024-01-20')
         UNION ALL SELECT seq, 'ID_CONFLICT' FROM (SELECT seq, close, first_value(close) OVER (PARTITION BY bar_id ORDER BY seq) AS f FROM fx_sent_bars) WHERE close <> f)
       GROUP BY 1""",
    uses=("fx_sent_bars",),
)
def bar_dedup(spark, sf_dir):
    rows = ledger.dedup_bars(fx_sent_bars(spark, sf_dir), cutoff())
    return rows.groupBy("dedup").agg(F.count(F.lit(1)).alias("bars"), F.sum("seq").alias("seq_sum"))


@plan(
    "a10_append_idempotent",
    """SELECT outcome, count(*) AS rows, sum(seq)::BIGINT AS seq_sum FROM (
         SELECT seq, CASE WHEN seq % 3 = 0 THEN 'APPENDED' WHEN seq % 5 = 0 THEN 'CONFLICT' ELSE 'DUPLICATE_NOOP' END AS outcome
         FROM fx_raw_minutes WHERE seq % 2 = 0) GROUP BY 1""",
    uses=("fx_raw_minutes",),
)
def append_idempotent(spark, sf_dir):
    bars = fx_raw_minutes(spark, sf_dir).drop("seen_at")
    existing = bars.filter(F.col("seq") % 3 != 0)
    close = F.when(F.col("seq") % 5 == 0, F.col("close") + 1.0).otherwise(F.col("close"))
    incoming = bars.filter(F.col("seq") % 2 == 0).withColumn("close", close)
    out = ledger.append_idempotent(existing, incoming, "bar_id")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("seq_sum"))


@plan(
    "a10_append_new",
    """SELECT seq, round(close, 6) AS close FROM fx_raw_minutes WHERE seq % 3 <> 0 OR seq % 2 = 0""",
    uses=("fx_raw_minutes",),
)
def append_new(spark, sf_dir):
    """A ledger written once and the same rows appended twice: the second time nothing is added."""
    bars = fx_raw_minutes(spark, sf_dir).drop("seen_at")
    path = scratch_path(spark, "bar-ledger")
    bars.filter(F.col("seq") % 3 != 0).write.parquet(path)
    for _ in range(2):
        writers.append_new(path, bars.filter(F.col("seq") % 2 == 0), "bar_id")
    return spark.read.schema(bars.schema).parquet(path).select("seq", F.round("close", 6).alias("close"))


@plan(
    "h1_merge_rows",
    """SELECT DISTINCT source_message_id, seq, processing_status, content_hash FROM fx_messages""",
    uses=("fx_messages",),
)
def merge_rows(spark, sf_dir):
    rows = fx_messages(spark, sf_dir).drop("text", "normalized_event_count")
    return ledger.merge_rows(rows.filter(F.col("seq") < 4), rows.filter(F.col("seq") >= 2))


@plan(
    "h1_identity_conflicts",
    """SELECT source_message_id FROM fx_messages GROUP BY 1 HAVING count(DISTINCT (seq, processing_status, content_hash)) > 1""",
    uses=("fx_messages",),
)
def identity_conflicts(spark, sf_dir):
    rows = fx_messages(spark, sf_dir).drop("text", "normalized_event_count")
    return ledger.identity_conflicts(
        rows.filter(F.col("seq") < 2), rows.filter(F.col("seq") >= 2), "source_message_id"
    )


@plan(
    "h3_set_difference_report",
    """SELECT coalesce(a.t, b.t) AS ticker, CASE WHEN b.t IS NULL THEN 'MISSING' ELSE 'EXTRA' END AS side
       FROM (SELECT DISTINCT ticker AS t FROM fx_holdings) a FULL JOIN (SELECT DISTINCT ticker AS t FROM fx_bars) b ON a.t = b.t
       WHERE a.t IS NULL OR b.t IS NULL""",
    uses=("fx_holdings", "fx_bars"),
)
def set_difference(spark, sf_dir):
    return ledger.set_difference(fx_holdings(spark, sf_dir), fx_bars(spark, sf_dir), "ticker")


@plan(
    "e11_events_per_message",
    """SELECT 'm' || conv_id AS source_message_id, count(*) AS events FROM conversations WHERE role = 'user' GROUP BY 1""",
)
def events_per_message(spark, sf_dir):
    rows = fx_messages(spark, sf_dir)
    return ledger.events_per_message(rows.filter(F.col("processing_status") == "DISCOVERED"))


LINKAGE_SQL = """SELECT e.source_message_id, CASE WHEN l.processing_status IS DISTINCT FROM 'COMMITTED' THEN 'NO_COMMITTED_STATE' ELSE 'EVENT_COUNT_DIFFERS' END AS rule,
              e.events, CAST(l.normalized_event_count AS INT) AS normalized_event_count
       FROM (SELECT source_message_id, count(*) AS events FROM fx_messages WHERE processing_status = 'DISCOVERED' GROUP BY 1) e
       LEFT JOIN (SELECT * FROM fx_messages QUALIFY row_number() OVER (PARTITION BY source_message_id ORDER BY seq DESC) = 1) l
         ON e.source_message_id = l.source_message_id
       WHERE l.processing_status IS DISTINCT FROM 'COMMITTED' OR l.normalized_event_count <> e.events"""


def _linkage(spark, sf_dir):
    rows = fx_messages(spark, sf_dir)
    events = rows.filter(F.col("processing_status") == "DISCOVERED").select("source_message_id")
    return ledger.linkage_violations(events, rows.drop("text"), ["seq"])


@plan("d13_message_event_linkage", LINKAGE_SQL, uses=("fx_messages",))
def message_event_linkage(spark, sf_dir):
    return _linkage(spark, sf_dir)


@plan(
    "g3_sample_first_k",
    f"SELECT source_message_id FROM ({LINKAGE_SQL}) ORDER BY source_message_id LIMIT 3",
    uses=("fx_messages",),
)
def sample_first_k(spark, sf_dir):
    return ledger.first_offenders(_linkage(spark, sf_dir), "source_message_id")


@plan(
    "d15_evidence_required",
    """SELECT e.id AS source_message_id, CASE WHEN l.source_message_id IS NULL THEN 'MISSING' ELSE 'WRONG_STATUS' END AS rule
       FROM (SELECT DISTINCT 'm' || (conv_id * 2) AS id FROM conversations) e
       LEFT JOIN (SELECT * FROM fx_messages QUALIFY row_number() OVER (PARTITION BY source_message_id ORDER BY seq DESC) = 1) l
         ON e.id = l.source_message_id
       WHERE l.source_message_id IS NULL OR l.processing_status <> 'COMMITTED'""",
    uses=("fx_messages",),
)
def evidence_required(spark, sf_dir):
    rows = fx_messages(spark, sf_dir)
    status = F.when(F.col("processing_status") == "COMMITTED", "ANCHOR_EVIDENCE").otherwise(F.col("processing_status"))
    index = rows.select(
        "source_message_id", "seq", status.alias("processing_status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("message_received_at"),
    )
    number = F.substring("source_message_id", 2, 20).cast("long") * 2
    expected = rows.select(F.concat(F.lit("m"), number.cast("string")).alias("source_message_id"))
    return ledger.evidence_problems(expected, index, ["seq"], cutoff())


@plan(
    "c13_anchor_contract",
    """SELECT account_ref, ticker, CASE WHEN n % 5 = 0 THEN 'ANCHOR_TIME_DIFFERS' WHEN n % 7 = 0 THEN 'COST_REQUIRED' WHEN n % 11 = 0 THEN 'DUPLICATE_POSITION' END AS rule, count(*) AS rows
       FROM (SELECT *, CAST(substr(account_ref, 2) AS INT) AS n FROM (SELECT DISTINCT account_ref, ticker FROM fx_trades))
       JOIN (VALUES (0), (1)) AS c(copy) ON copy = 0 OR n % 11 = 0 GROUP BY 1, 2, 3""",
    uses=("fx_trades",),
)
def anchor_contract(spark, sf_dir):
    n = F.substring("account_ref", 2, 4).cast("int")
    base = fx_anchor(spark, sf_dir)
    rows = base.unionByName(base.filter(n % 11 == 0)).select(
        "account_ref", "ticker", "shares", "entry_date", F.lit("user_chat").alias("source"),
        F.when(n % 7 != 0, F.col("avg_cost")).alias("avg_cost"),
        F.when(n % 5 == 0, cutoff()).otherwise(F.col("anchor_at")).alias("anchor_at"),
    )
    expected = F.lit("1995-01-01 00:00:00").cast("timestamp")
    marked = ledger.anchor_rules(staged(rows, "anchors"), expected, "EXACT_USER_ANCHOR")
    return marked.groupBy("account_ref", "ticker", "rule").agg(F.count(F.lit(1)).alias("rows"))


# --- state machines -------------------------------------------------------------------

@plan(
    "i4_candidate_replay",
    """SELECT ticker, rule, event_id AS detail, seq FROM state_rules WHERE rule IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) = 1""",
    uses=("state_rules",),
)
def candidate_replay(spark, sf_dir):
    return eventlog.candidate_violations(staged(fx_statelog(spark, sf_dir), "statelog"))


@plan(
    "i4_candidate_final_state",
    "SELECT ticker, state FROM state_final",
    uses=("state_final",),
)
def candidate_final(spark, sf_dir):
    return eventlog.candidate_final(fx_statelog(spark, sf_dir))


@plan(
    "f17_current_state_before",
    """SELECT event_id, ticker, coalesce(cur, 'NONE') AS current_state FROM state_rows""",
    uses=("state_rows",),
)
def current_state_before(spark, sf_dir):
    rows = eventlog.candidate_states(staged(fx_statelog(spark, sf_dir), "statelog"))
    return rows.select("event_id", "ticker", F.coalesce("current_state", F.lit("NONE")).alias("current_state"))


@plan(
    "f16_time_order_check",
    """SELECT seq, account_ref FROM (SELECT seq, account_ref, received, max(received) OVER (PARTITION BY account_ref ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fx_broker) WHERE received < before""",
    uses=("fx_broker",),
)
def time_order_check(spark, sf_dir):
    log = fx_broker(spark, sf_dir).select(
        "seq", "account_ref", F.col("message_received_at").alias("occurred_at")
    )
    return eventlog.time_order_violations(log, "account_ref").select("seq", "account_ref")


@plan(
    "d14_ledger_vs_watchlist",
    """SELECT coalesce(s.ticker, w.ticker) AS ticker, s.state AS log_state, w.state AS table_state,
              CASE WHEN w.state IS NULL THEN 'MISSING_FROM_TABLE' ELSE 'STATE_DIFFERS' END AS problem
       FROM state_final s FULL JOIN (SELECT DISTINCT 'U' || user_id AS ticker, 'WATCHING' AS state FROM events WHERE user_id % 3 <> 0
              UNION ALL SELECT DISTINCT 'X' || user_id, 'PAUSED' FROM events WHERE user_id % 10 = 0) w ON s.ticker = w.ticker
       WHERE (w.state IS NULL AND s.state <> 'REMOVED') OR (w.state IS NOT NULL AND s.state IS DISTINCT FROM w.state)""",
    uses=("state_final",),
)
def ledger_vs_watchlist(spark, sf_dir):
    log = fx_statelog(spark, sf_dir)
    number = F.substring("ticker", 2, 20).cast("long")
    tickers = log.select("ticker").distinct()
    watch = tickers.filter(number % 3 != 0).select("ticker", F.lit("WATCHING").alias("state")).unionByName(
        tickers.filter(number % 10 == 0).select(
            F.concat(F.lit("X"), number.cast("string")).alias("ticker"), F.lit("PAUSED").alias("state")
        )
    )
    return eventlog.ledger_vs_watchlist(eventlog.candidate_final(log), watch)


@plan(
    "d14_active_gate",
    """SELECT count(*) FILTER (WHERE state <> 'REMOVED') AS active, count(*) FILTER (WHERE state <> 'REMOVED') > 5 AS too_many FROM state_final""",
    uses=("state_final",),
)
def active_gate(spark, sf_dir):
    return eventlog.active_gate(eventlog.candidate_final(fx_statelog(spark, sf_dir)))


@plan(
    "i5_decision_replay",
    """SELECT decision_id, rule, event_id AS detail, seq FROM decision_rules
       WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY k) = 1""",
    uses=("decision_rules",),
)
def decision_replay(spark, sf_dir):
    return eventlog.decision_violations(fx_decision_log(spark, sf_dir))


OVERLAY_SQL = """WITH RECURSIVE e AS (
         SELECT 'A' || (user_id % 50) AS account_ref, event_id AS seq, 'corr-' || lpad(event_id::VARCHAR, 9, '0') AS id,
                event_id - CASE WHEN event_id % 7 = 0 THEN 777600 ELSE 0 END AS happened FROM events WHERE event_type = 'view'),
       f AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN seq % 9 <> 0 AND seq % 7 <> 0 THEN id END IGNORE NULLS)
                       OVER (PARTITION BY account_ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good
             FROM e WINDOW w AS (PARTITION BY account_ref ORDER BY seq)),
       o AS (SELECT *, CASE WHEN seq % 9 = 0 OR (seq % 7 = 0 AND good IS NULL) THEN 'corr-000000' ELSE good END AS wanted FROM f),
       w(account_ref, n, seq, cur, cur_at, status) AS (
         SELECT DISTINCT account_ref, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR FROM o
         UNION ALL
         SELECT account_ref, n, seq, CASE WHEN status = 'COMMIT' THEN id ELSE cur END, CASE WHEN status = 'COMMIT' THEN happened ELSE cur_at END, status
         FROM (SELECT o.account_ref, o.n, o.seq, o.id, o.happened, w.cur, w.cur_at,
                      CASE WHEN cur IS NULL AND wanted IS NULL THEN 'COMMIT' WHEN cur IS NULL THEN 'NOTHING_TO_REPLACE'
                           WHEN wanted IS DISTINCT FROM cur THEN 'PREVIOUS_DIFFERS' WHEN happened <= cur_at THEN 'NOT_LATER' ELSE 'COMMIT' END AS status
               FROM w JOIN o ON o.account_ref = w.account_ref AND o.n = w.n + 1))"""


@plan(
    "i7_overlay_chain",
    OVERLAY_SQL + " SELECT account_ref, seq, status FROM w WHERE n > 0",
)
def overlay_chain(spark, sf_dir):
    rows = overlay.overlay_chain(fx_corrections(spark, sf_dir))
    return rows.select("account_ref", "seq", "status")


@plan(
    "i7_latest_overlay",
    OVERLAY_SQL
    + """ SELECT account_ref, 'corr-' || lpad(seq::VARCHAR, 9, '0') AS correction_id, seq % 2 = 0 AS active
          FROM w WHERE status = 'COMMIT' QUALIFY row_number() OVER (PARTITION BY account_ref ORDER BY seq DESC) = 1""",
)
def latest_overlay(spark, sf_dir):
    """The correction in force of each account, out of its whole chain."""
    return overlay.latest_overlay(overlay.overlay_chain(fx_corrections(spark, sf_dir))).select("account_ref", "correction_id", "active")


@plan(
    "i8_active_holdings_view",
    """SELECT account_ref, basis, count(*) AS rows, round(sum(shares), 4) AS shares FROM (
         SELECT h.account_ref, CASE WHEN active AND late THEN 'OVERLAY_STALE' WHEN active THEN 'OVERLAY' ELSE 'DERIVED' END AS basis,
                CASE WHEN active THEN shares + 1 ELSE shares END AS shares
         FROM fx_holdings h JOIN (SELECT o.*, EXISTS (SELECT 1 FROM broker_pos p WHERE moves AND p.account_ref = o.account_ref
                                    AND p.trade_time > o.corrected_at) AS late FROM fx_overlays o) o ON h.account_ref = o.account_ref)
       GROUP BY 1, 2""",
    uses=("fx_holdings", "broker_pos", "fx_overlays"),
)
def active_holdings(spark, sf_dir):
    derived = fx_holdings(spark, sf_dir).select("account_ref", "ticker", "shares")
    overlays = fx_overlays(spark, sf_dir)
    corrected = derived.select(
        "account_ref", F.concat(F.lit("corr-"), "account_ref").alias("correction_id"), "ticker",
        (F.col("shares") + 1).alias("shares"),
    )
    events = fx_broker(spark, sf_dir).filter(ledger.position_affecting())
    rows = overlay.active_holdings(derived, corrected, overlays, events)
    return rows.groupBy("account_ref", "basis").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("shares"), 4).alias("shares")
    )


@plan(
    "c14_overlay_contract",
    """SELECT account_ref AS correction_ref, ticker, CASE WHEN n % 6 = 0 THEN 'BAD_SOURCE' WHEN n % 4 = 0 THEN 'BAD_NUMBER' END AS rule
       FROM (SELECT *, CAST(substr(account_ref, 2) AS INT) AS n FROM fx_holdings)""",
    uses=("fx_holdings",),
)
def overlay_contract(spark, sf_dir):
    n = F.substring("account_ref", 2, 4).cast("int")
    rows = fx_holdings(spark, sf_dir).select(
        F.concat(F.lit("corr-00"), "account_ref").alias("correction_id"),
        F.when(n % 6 == 0, "file").otherwise("user_chat").alias("source"),
        F.lower("ticker").alias("ticker"),
        F.when(n % 4 == 0, "-1").otherwise(F.col("shares").cast("string")).alias("shares"),
        F.lit("待确认").alias("avg_cost"),
    )
    marked = ledger.overlay_rules(rows, ["shares", "avg_cost"])
    return marked.select(F.substring("correction_id", 8, 10).alias("correction_ref"), "ticker", "rule")


# --- scan batches ---------------------------------------------------------------------

def batches(spark, sf_dir):
    """Nested scan batches, written as JSON documents and read by their declared schema."""
    return readers.rescan_json(fx_batches(spark, sf_dir), "batches")


@plan(
    "a5_scan_batch_json",
    """SELECT batch_id, count(*) AS messages, sum(n_events)::BIGINT AS events, CAST(min(b) * 10 + 12 AS BIGINT) AS completed_minute
       FROM msg JOIN batch USING (b) GROUP BY 1""",
    uses=("msg", "batch"),
)
def scan_batch_json(spark, sf_dir):
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    n = F.aggregate("messages", F.lit(0).cast("long"), lambda acc, m: acc + F.size(m["events"]))
    return batches(spark, sf_dir).select(
        "batch_id", F.size("messages").cast("long").alias("messages"), n.alias("events"),
        ((F.unix_seconds("scan.completed_at") - start) / 60).cast("long").alias("completed_minute"),
    )


@plan(
    "a6_flatten_batch",
    """SELECT 'idx-' || substr(sha256(batch_id || '|m' || c || '|' || s), 1, 24) AS index_event_id, 'm' || c AS source_message_id,
              s AS processing_status, CAST(n_events AS INT) AS normalized_event_count
       FROM (SELECT batch_id, c, n_events, unnest(['DISCOVERED', status]) AS s FROM msg JOIN batch USING (b))""",
    uses=("msg", "batch"),
)
def flatten_batch(spark, sf_dir):
    rows = ledger.flatten_index(ledger.message_rows(batches(spark, sf_dir)))
    return rows.select("index_event_id", "source_message_id", "processing_status", "normalized_event_count")


@plan(
    "a6_flatten_batch_events",
    """SELECT 'm' || c AS source_message_id, 'ex-' || c AS execution_id, count(*) AS n
       FROM (SELECT c, unnest(range(n_events)) FROM msg) GROUP BY 1, 2""",
    uses=("msg",),
)
def flatten_batch_events(spark, sf_dir):
    rows = ledger.flatten_events(ledger.message_rows(batches(spark, sf_dir)))
    return rows.groupBy("source_message_id", "execution_id").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "a6_flatten_quarantine",
    """SELECT 'm' || c AS source_message_id, 't' || c AS source_thread_id, 'unclear' AS reason,
              CASE WHEN c % 10 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS resolution_status, c % 10 <> 0 AS open
       FROM msg WHERE c % 5 = 0""",
    uses=("msg",),
)
def flatten_quarantine(spark, sf_dir):
    """Quarantine rows of all batches, and which of them are still open."""
    rows = staged(ledger.flatten_quarantine(ledger.message_rows(batches(spark, sf_dir))), "quarantine")
    still = ledger.unresolved(rows, ["parsed_at"]).select("source_message_id", F.lit(True).alias("open"))
    return rows.join(still, "source_message_id", "left").select(
        "source_message_id", "source_thread_id", "reason", "resolution_status", F.coalesce("open", F.lit(False)).alias("open")
    )


@plan(
    "h4_discovered_only",
    """SELECT 'm' || c AS source_message_id, batch_id FROM msg JOIN batch USING (b)""",
    uses=("msg", "batch"),
)
def discovered_only(spark, sf_dir):
    index = ledger.flatten_index(ledger.message_rows(fx_batches(spark, sf_dir)))
    return ledger.discovered_only(index).select("source_message_id", "batch_id")


@plan(
    "c11_batch_contract",
    """SELECT batch_id, CASE WHEN b % 37 = 0 THEN 'SCHEMA_VERSION' WHEN b % 11 = 0 THEN 'NO_PAGES' END AS rule FROM batch""",
    uses=("batch",),
)
def batch_contract(spark, sf_dir):
    return fx_batches(spark, sf_dir).select("batch_id", ledger.batch_rules().alias("rule"))


@plan(
    "c12_message_contract",
    """SELECT 'm' || c AS source_message_id, CASE WHEN c % 41 = 0 THEN 'METADATA_MISSING'
              WHEN status = 'COMMITTED' AND n_events = 0 THEN 'COMMITTED_WITHOUT_EVENTS'
              WHEN n_events > 0 AND c % 8 = 0 THEN 'EVENT_AFTER_SCAN' END AS rule FROM msg""",
    uses=("msg",),
)
def message_contract(spark, sf_dir):
    rows = staged(ledger.message_rows(fx_batches(spark, sf_dir)), "messages")
    return ledger.message_rules(rows).select("source_message_id", "rule")


#: Fields of an event and of a quarantine record in this fixture's ledgers.
EVENT_FIELDS = ("execution_id", "ticker", "affects_position", "quantity", "trade_time", *contracts.DERIVED_EVENT)
QUARANTINE_FIELDS = ("reason", "resolution_status", *contracts.DERIVED_QUARANTINE)


def batch_documents(spark, sf_dir):
    """Batches as JSON text with planted fields at every level, a missing one, a wrong type and broken documents."""
    rows = fx_batches(spark, sf_dir)
    b = F.col("scan_no") - 1

    def message(m):
        n = F.substring(m["source_message_id"], 2, 18).cast("long")
        strange = F.when(n % 9 == 0, "someone else").when(n % 9 == 1, m["sender"])
        record = m["quarantine"]
        record = F.when(
            record.isNotNull(),
            record.withField("extra", F.when(n % 15 == 0, "?")).withField("reason", F.when(n % 25 == 0, "  ").otherwise(record["reason"])),
        )
        events = F.transform(m["events"], lambda e: e.withField("venue", F.when(n % 7 == 0, "X")).withField("sender", strange))
        return m.withField("mood", F.when(n % 16 == 0, "calm")).withField("events", events).withField("quarantine", record)

    token = F.when(b % 8 != 3, F.col("scan.terminal_next_page_token"))
    rows = rows.withColumn("scan", F.col("scan").withField("terminal_next_page_token", token)).withColumn(
        "messages", F.transform("messages", message)
    )
    known = [c for c in rows.columns if c not in ("transaction_id", "scan_no")]
    body = F.to_json(F.struct(*known, F.when(b % 9 == 0, 1).alias("surprise")))
    body = F.when(b % 5 == 2, F.regexp_replace(body, r'"pages_fetched":(\d)', '"pages_fetched":"$1"')).otherwise(body)
    body = F.when(b % 29 == 0, "[1]").when(b % 31 == 0, "{broken").otherwise(body)
    return rows.select("batch_id", body.alias("body"))


@plan(
    "c11_field_contract",
    """SELECT batch_id, level, place, field, rule FROM (
         SELECT b, 'batch' AS level, '' AS place, '' AS field, 'NOT_AN_OBJECT' AS rule FROM batch WHERE b % 29 = 0 OR b % 31 = 0
         UNION ALL SELECT b, 'batch', '', 'surprise', 'UNKNOWN_FIELD' FROM ok WHERE b % 9 = 0
         UNION ALL SELECT b, 'scan', '', 'terminal_next_page_token', 'MISSING_FIELD' FROM ok WHERE b % 8 = 3
         UNION ALL SELECT b, 'scan', '', 'pages_fetched', 'WRONG_TYPE' FROM ok WHERE b % 5 = 2
         UNION ALL SELECT b, 'message', place, 'mood', 'UNKNOWN_FIELD' FROM placed WHERE c % 16 = 0
         UNION ALL SELECT b, 'event', place || '.' || e, 'venue', 'UNKNOWN_FIELD' FROM (SELECT *, unnest(range(n_events)) AS e FROM placed) WHERE c % 7 = 0
         UNION ALL SELECT b, 'event', place || '.' || e, 'sender', 'CONFLICTING_FIELD' FROM (SELECT *, unnest(range(n_events)) AS e FROM placed) WHERE c % 9 = 0
         UNION ALL SELECT b, 'quarantine', place, 'extra', 'UNKNOWN_FIELD' FROM placed WHERE c % 15 = 0
         UNION ALL SELECT b, 'quarantine', place, 'reason', 'EMPTY_FIELD' FROM placed WHERE c % 25 = 0) JOIN batch USING (b)""",
    uses=("batch", "ok", "placed"),
)
def field_contract(spark, sf_dir):
    documents = contracts.read_documents(batch_documents(spark, sf_dir), "body", "batch_id")
    return contracts.batch_violations(documents, "batch_id", EVENT_FIELDS, QUARANTINE_FIELDS)


GATE_SQL = """SELECT batch_id, b,
         list_sort(list_filter([CASE WHEN b % 7 = 0 THEN 'pagination_incomplete' END, CASE WHEN b % 4 = 0 THEN 'terminal_next_page_token_not_empty' END,
           CASE WHEN o > 0 THEN 'unresolved_quarantine_in_batch' END, CASE WHEN o > 0 THEN 'unresolved_quarantine' END], lambda x: x IS NOT NULL)) AS r
       FROM (SELECT batch_id, b, count(*) FILTER (WHERE c % 5 = 0 AND c % 10 <> 0) AS o FROM msg JOIN batch USING (b) GROUP BY 1, 2)"""


@plan(
    "j13_batch_gate",
    f"""SELECT batch_id, CASE WHEN len(r) > 0 THEN 'BLOCKED' ELSE 'SUCCESS' END AS commit_status, array_to_string(r, ',') AS blocked_reasons,
               CAST(b * 100 AS VARCHAR) AS waterline_before,
               CAST(CASE WHEN len(r) > 0 THEN b * 100 WHEN b % 6 = 0 THEN b * 100 - 50 ELSE b * 100 + 100 END AS VARCHAR) AS waterline_after
        FROM ({GATE_SQL})""",
    uses=("msg", "batch"),
)
def batch_gate(spark, sf_dir):
    rows = fx_batches(spark, sf_dir)
    return ledger.batch_gate(rows, ledger.message_rows(rows))


@plan(
    "e14_blocked_reasons",
    f"SELECT reason, count(*) AS batches FROM (SELECT unnest(r) AS reason FROM ({GATE_SQL})) GROUP BY 1",
    uses=("msg", "batch"),
)
def blocked_reasons(spark, sf_dir):
    rows = fx_batches(spark, sf_dir)
    gate = ledger.batch_gate(rows, ledger.message_rows(rows))
    reason = F.explode(F.split("blocked_reasons", ",")).alias("reason")
    return gate.filter(F.col("blocked_reasons") != "").select(reason).groupBy("reason").agg(
        F.count(F.lit(1)).alias("batches")
    )


#: Each scan judged in turn against the cursor that the last accepted one left.
WATERLINE_SQL = """WITH RECURSIVE f AS (
       SELECT batch_id, CAST(b AS BIGINT) AS b, b % 7 = 2 AS blocked, b % 6 = 5 AS backwards, b % 10 = 3 AS wrong, b % 13 = 8 AS stale FROM batch),
     g AS (SELECT *, last_value(CASE WHEN NOT (backwards OR wrong OR stale) THEN b END IGNORE NULLS) OVER w AS parent,
                  coalesce(last_value(CASE WHEN NOT (backwards OR wrong OR stale OR blocked) THEN (b + 1) * 100 END IGNORE NULLS) OVER w, 0) AS line
           FROM f WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     o AS (SELECT *, row_number() OVER (ORDER BY b) AS n, CASE WHEN stale THEN -1 ELSE parent END AS names,
                  CASE WHEN wrong THEN line + 1 ELSE line END AS low, CASE WHEN backwards THEN line - 50 ELSE (b + 1) * 100 END AS high FROM g),
     w(n, batch_id, cur, cur_line, rule) AS (
       SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR
       UNION ALL
       SELECT n, batch_id, CASE WHEN rule IS NULL THEN b ELSE cur END,
              CASE WHEN rule IS NULL THEN CASE WHEN blocked THEN low ELSE high END ELSE cur_line END, rule
       FROM (SELECT o.*, w.cur, w.cur_line,
                    CASE WHEN cur IS NOT NULL AND names IS DISTINCT FROM cur THEN 'STALE_PARENT'
                         WHEN cur_line IS NOT NULL AND low <> cur_line THEN 'WATERLINE_DIFFERS'
                         WHEN high < low THEN 'WATERLINE_BACKWARDS' END AS rule
             FROM w JOIN o ON o.n = w.n + 1))
     SELECT batch_id, rule FROM w WHERE n > 0"""


@plan("j14_waterline_check", f"SELECT batch_id, rule FROM ({WATERLINE_SQL})", uses=("batch",))
def waterline_check(spark, sf_dir):
    return ledger.waterline_rules(fx_scans(spark, sf_dir), ["scan_no"]).select("batch_id", "rule")
