"""Trading-calendar joins: session numbering, run gates and slot labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.functions.columns import NEW_YORK, minute_of_day, session_date

# The default run slots (minutes of the New York day) per mode.
DEFAULT_SLOTS = {
    "intraday": (570, 630, 690, 750),
    "daily-review": (750,),
    "post-close": (990,),
    "weekly-review": (1005,),
    "monthly-review": (1020,),
}
POST_CLOSE_MODES = ("post-close", "weekly-review", "monthly-review")


def number_sessions(days: DataFrame, *, open_hour: float, close_hour: float) -> DataFrame:
    """Number distinct ``session_date`` rows; a calendar has at most one row per day.

    The unpartitioned window is bounded by the calendar (about 252 rows a year),
    not by the data.
    """
    ordered = Window.orderBy("session_date")
    start = F.unix_micros(F.col("session_date").cast("timestamp"))
    return days.select(
        "session_date",
        F.row_number().over(ordered).alias("session_idx"),
        F.timestamp_micros((start + int(open_hour * 3_600_000_000)).cast("long")).alias("open_ts"),
        F.timestamp_micros((start + int(close_hour * 3_600_000_000)).cast("long")).alias("close_ts"),
        F.lead("session_date").over(ordered).alias("next_session"),
    )


def _iso_week(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def classify_instants(
    instants: DataFrame,
    calendar: DataFrame,
    *,
    at: str,
    mode: str,
    slots: Sequence[int] | None = None,
    window_minutes: int = 15,
    zone: str = NEW_YORK,
) -> DataFrame:
    """Label every instant with its session, phase, cadence and run slot.

    ``calendar`` holds at most one row per day, so it is broadcast. The skip
    reason follows a fixed priority: window, session, phase, cadence.
    """
    chosen = sorted(set(slots if slots is not None else DEFAULT_SLOTS[mode]))
    clock = F.from_utc_timestamp(F.col(at), zone)
    day = session_date(F.col(at), zone)
    minute = minute_of_day(F.col(at), zone)
    slot = F.lit(None).cast("int")
    for start in reversed(chosen):
        hit = (minute >= start) & (minute < start + window_minutes)
        slot = F.when(hit, start).otherwise(slot)
    days = calendar.select(
        F.col("session_date").alias("_day"), "open_ts", "close_ts", "next_session"
    )
    joined = instants.withColumn("_day", day).join(F.broadcast(days), "_day", "left")
    in_session = (F.col(at) >= F.col("open_ts")) & (F.col(at) < F.col("close_ts"))
    after = F.col(at) >= F.col("close_ts")
    week_end = _iso_week(F.col("_day")) != _iso_week(F.col("next_session"))
    month_end = F.trunc("_day", "month") != F.trunc("next_session", "month")
    due = {"weekly-review": week_end, "monthly-review": month_end}.get(mode, F.lit(True))
    phase_ok = after if mode in POST_CLOSE_MODES else in_session
    label = F.format_string("%02d%02d", F.floor(F.col("_slot") / 60).cast("int"), F.col("_slot") % 60)
    return (
        joined.withColumn("_slot", slot)
        .withColumn("is_session", F.col("open_ts").isNotNull())
        .withColumn("in_regular_session", F.coalesce(in_session, F.lit(False)))
        .withColumn("after_regular_session", F.coalesce(after, F.lit(False)))
        .withColumn("cadence_ok", ~F.col("is_session") | F.coalesce(due, F.lit(True)))
        .withColumn(
            "scheduled_slot",
            F.when(
                F.col("_slot").isNotNull(),
                F.concat_ws("-", F.col("_day").cast("string"), label, F.lit("ET"), F.lit(mode)),
            ),
        )
        .withColumn(
            "skip_reason",
            F.when(F.col("_slot").isNull(), "SKIP_OUTSIDE_SCHEDULED_WINDOW")
            .when(~F.col("is_session"), "SKIP_NON_SESSION")
            .when(~F.coalesce(phase_ok, F.lit(False)), "SKIP_WRONG_MARKET_PHASE")
            .when(~F.col("cadence_ok"), "SKIP_CADENCE_NOT_DUE"),
        )
        .withColumn("execute_gate", F.col("skip_reason").isNull())
        .withColumn("local_minute", F.hour(clock) * 60 + F.minute(clock))
        .withColumnRenamed("_day", "local_date")
        .drop("_slot", "next_session")
    )


def classify_midnight(
    instants: DataFrame, calendar: DataFrame, *, at: str, clock_zone: str = "Asia/Shanghai",
    window_minutes: int = 15, zone: str = NEW_YORK,
) -> DataFrame:
    """The variant whose window is the first minutes after midnight in another zone."""
    clock = F.from_utc_timestamp(F.col(at), clock_zone)
    in_window = (F.hour(clock) == 0) & (F.minute(clock) < window_minutes)
    days = calendar.select(F.col("session_date").alias("_day"), "open_ts", "close_ts")
    joined = instants.withColumn("_day", session_date(F.col(at), zone)).join(
        F.broadcast(days), "_day", "left"
    )
    in_session = F.coalesce(
        (F.col(at) >= F.col("open_ts")) & (F.col(at) < F.col("close_ts")), F.lit(False)
    )
    return (
        joined.withColumn("is_session", F.col("open_ts").isNotNull())
        .withColumn(
            "scheduled_slot",
            F.when(in_window, F.concat(F.to_date(clock).cast("string"), F.lit("-0000-CST"))),
        )
        .withColumn(
            "skip_reason",
            F.when(~in_window, "SKIP_OUTSIDE_SCHEDULED_WINDOW")
            .when(~F.col("is_session"), "SKIP_NON_SESSION")
            .when(~in_session, "SKIP_OUTSIDE_REGULAR_SESSION"),
        )
        .withColumn("execute_gate", F.col("skip_reason").isNull())
        .drop("_day", "open_ts", "close_ts")
    )
