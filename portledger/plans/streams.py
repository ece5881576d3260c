"""Plans that run the streaming twins over file streams of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from portledger.plans.fixtures import (
    fx_broker,
    fx_decision_log,
    fx_messages,
    fx_raw_minutes,
    fx_scans,
    fx_statelog,
    fx_trades,
)
from portledger.operators import positions as p
from portledger.plans.ledgers import WATERLINE_SQL
from portledger.plans.registry import plan
from portledger.streaming import ledgers as s


@plan(
    "k1_stream_dedup_by_id",
    "SELECT bar_id, ticker, close FROM fx_raw_minutes",
    uses=("fx_raw_minutes",),
)
def stream_dedup(spark, sf_dir):
    bars = fx_raw_minutes(spark, sf_dir)
    twice = bars.unionByName(bars.filter(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + 500))
    drain, path = s.into_table(
        twice, "bars-unique",
        lambda stream: s.dedup_by_id(stream, "bar_id", "bar_at", "31 days").select("bar_id", "ticker", "close"),
    )
    s.feed(twice, "bars-stream", drain)
    return spark.read.schema("bar_id string, ticker string, close double").parquet(path)


@plan(
    "k2_stream_overlap_rescan",
    "SELECT DISTINCT source_message_id, seq, processing_status, content_hash FROM fx_messages",
    uses=("fx_messages",),
)
def stream_overlap(spark, sf_dir):
    rows = fx_messages(spark, sf_dir).drop("text", "normalized_event_count")
    return s.merge_overlapping(rows.unionByName(rows.filter(F.col("seq") % 2 == 0)), "messages", list(rows.columns))


@plan(
    "k3_stream_late_data",
    """SELECT CAST(CAST(trade_time AS DATE) AS VARCHAR) AS day, count(*) AS known FROM fx_broker
       WHERE trade_time <= TIMESTAMP '2024-01-20' AND received <= TIMESTAMP '2024-01-20' GROUP BY 1""",
    uses=("fx_broker",),
)
def stream_late(spark, sf_dir):
    rows = fx_broker(spark, sf_dir).select("seq", "trade_time", "message_received_at")
    path = s.scratch_path(spark, "known")

    def handle(batch, number):
        # Complete mode: each batch is the whole table as now known.
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    whole = s.by_batch(rows, "known", handle, mode="complete")
    s.feed(
        rows, "broker-stream",
        lambda stream: whole(
            s.visible_by_learn_time(stream, "message_received_at", "trade_time", "2024-01-20 00:00:00")
        ),
    )
    known = spark.read.schema("day date, known long").parquet(path)
    return known.select(F.col("day").cast("string").alias("day"), "known")


@plan(
    "k4_stream_candidate_state",
    """SELECT ticker, event_id, seq, coalesce(CASE WHEN event_type <> 'CANDIDATE_REVIEWED' THEN new_state ELSE cur END, '') AS state, coalesce(rule, '') AS rule FROM state_rules""",
    uses=("state_rules",),
)
def stream_candidates(spark, sf_dir):
    out = s.live_candidates(fx_statelog(spark, sf_dir), "statelog-stream")
    return out.select(
        "ticker", "event_id", "seq", F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("rule", F.lit("")).alias("rule"),
    )


@plan(
    "k5_stream_decision_outbox",
    "SELECT decision_id, event_id, seq, coalesce(rule, '') AS rule FROM decision_rules",
    uses=("decision_rules",),
)
def stream_decisions(spark, sf_dir):
    out = s.live_decisions(fx_decision_log(spark, sf_dir), "decisions-stream")
    return out.select("decision_id", "event_id", "seq", F.coalesce("rule", F.lit("")).alias("rule"))


@plan(
    "k6_stream_positions",
    """SELECT account_ref, ticker, n AS fills, refused, q AS shares, round(cost + 3e-5, 2) AS total_cost, round(realised + 3e-5, 2) AS realised FROM live WHERE lj = n""",
    uses=("live",),
)
def stream_positions(spark, sf_dir):
    """Fills arrive by trade day, but every eleventh by half a year later, behind newer ones of its position."""
    fills = p.prepare(fx_trades(spark, sf_dir)).select(
        "account_ref", "ticker", "side", F.col("quantity").cast("double").alias("quantity"), "price", "fees", "pos",
        F.col("seq").alias("item"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("tie"),
        (F.floor(F.col("pos") / 86_400_000_000) + F.when(F.pmod(F.xxhash64("seq", "pos"), F.lit(11)) == 0, 180).otherwise(0)).alias("seq"),
    )
    return s.live_positions(fills, "live-positions").withColumns(
        {c: F.round(F.col(c) + 3e-5, 2) for c in ("total_cost", "realised")}
    )


@plan("k7_stream_waterline", f"SELECT batch_id, rule FROM ({WATERLINE_SQL})", uses=("batch",))
def stream_waterline(spark, sf_dir):
    return s.check_waterline(fx_scans(spark, sf_dir).withColumn("seq", F.col("scan_no")), "scans")
