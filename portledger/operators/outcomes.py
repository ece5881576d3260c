"""Scoring delivered decisions at fixed horizons without look-ahead.

Every lookup is an equi-join against one row per (ticker, minute), (ticker,
quarter hour) or (ticker, session), with hot keys salted. Price paths are never
expanded per decision: bars are summed up once in blocks of minutes, and a path
between two fills or ends is a handful of blocks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.functions.columns import NEW_YORK, ceil_to_minute, fmt_outcome, session_date
from portledger.operators.audit import stamp
from portledger.operators.ledger import visible_as_of
from portledger.operators.paths import RADIX, SIZES, blocks, extremes, units
from portledger.operators.scans import Order, drop_chunks, running, with_chunks
from portledger.operators.skew import attach
from portledger.sources.staging import staged

# The horizons with their session offsets.
HORIZONS = (("1h", 0), ("close", 0), ("1d", 1), ("5d", 5), ("20d", 20))
QUARTER = 900_000_000
KEY = ("decision_id", "ticker")


@dataclass(frozen=True)
class OutcomeRules:
    """Parameters of the scoring; ``as_of`` is the knowledge cut-off as an instant."""

    as_of: str
    cost_bps: float = 10.0
    benchmark: str = "SPY"
    zone: str = NEW_YORK
    default_exposure: tuple[tuple[str, float], ...] = (("HOLD", 1.0), ("WATCH", 1.0))

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")


def decision_delivery(log: DataFrame, rules: OutcomeRules) -> DataFrame:
    """Created decisions with their delivery, both visible at ``as_of``."""
    seen = log.filter(F.col("occurred_at") <= rules.now())
    created = seen.filter(F.col("event_type") == "DECISION_CREATED")
    sent = (
        seen.filter(F.col("event_type") == "EMAIL_SENT")
        .groupBy("decision_id")
        .agg(F.max("occurred_at").alias("delivered_at"))
    )
    return (
        created.join(sent, "decision_id", "left")
        .withColumn("created_at", F.col("occurred_at"))
        .withColumn("decision_at", F.coalesce("delivered_at", "occurred_at"))
        .drop("event_type", "occurred_at", "seq")
    )


def decision_holdings(decisions: DataFrame, rules: OutcomeRules) -> DataFrame:
    """One row per decision and holding; exposure defaults by action, else stays missing."""
    rows = decisions.withColumn("_h", F.explode("holdings")).drop("holdings")
    defaults = F.create_map(*[F.lit(x) for pair in rules.default_exposure for x in pair])
    return rows.select(
        *[c for c in rows.columns if c != "_h"],
        F.upper(F.trim("_h.ticker")).alias("ticker"),
        F.col("_h.action").alias("action"),
        F.coalesce("_h.recommended_exposure", F.element_at(defaults, F.col("_h.action"))).alias("exposure"),
        F.col("_h.shares").alias("start_shares"),
    )


def by_horizon(rows: DataFrame) -> DataFrame:
    """Five rows per holding: an exploded literal, not a cross join."""
    options = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(k).alias("offset")) for n, k in HORIZONS])
    return rows.withColumn("_o", F.explode(options)).select("*", "_o.*").drop("_o")


def _sessions(calendar: DataFrame) -> DataFrame:
    return calendar.select("session_date", "session_idx", "close_ts")


def with_reference(rows: DataFrame, bars: DataFrame, calendar: DataFrame, rules: OutcomeRules, **limits) -> DataFrame:
    """Adds the first whole minute at or after delivery: price, time and status."""
    now = rules.now()
    minutes = (
        bars.filter(F.col("bar_type") == "INTRADAY")
        .groupBy("ticker", F.col("bar_at").alias("_start"))
        .agg(
            F.min_by(
                F.struct(F.col("close").alias("reference_price"), F.col("price_at").alias("reference_at")),
                F.struct("collected_at", "bar_id"),
            ).alias("_ref")
        )
    )
    keyed = rows.withColumn("_start", ceil_to_minute(F.col("delivered_at"))).withColumn(
        "session_date", session_date(F.col("decision_at"), rules.zone)
    )
    keyed = keyed.join(F.broadcast(_sessions(calendar)), "session_date", "left")
    found = attach(keyed, minutes, ["ticker", "_start"], **limits)
    minute = F.expr("interval 1 minute")
    status = (
        F.when(F.col("delivered_at").isNull(), "NOT_DELIVERED")
        .when(F.col("close_ts").isNull(), "NOT_APPLICABLE")
        .when(F.col("_start") + minute > F.col("close_ts"), "NOT_APPLICABLE")
        .when(F.col("_ref").isNotNull(), "MATURED")
        .when(now < F.col("delivered_at") + F.expr("interval 6 minutes"), "PENDING")
        .otherwise("PENDING_DATA")
    )
    usable = F.col("reference_status") == "MATURED"
    return (
        found.withColumn("reference_status", status)
        .withColumn("reference_price", F.when(usable, F.col("_ref.reference_price")))
        .withColumn("reference_at", F.when(usable, F.col("_ref.reference_at")))
        .drop("_start", "_ref")
    )


def quarter_hours(bars: DataFrame) -> DataFrame:
    """Minutes within a quarter hour of each quarter-hour bucket: at most 45 per row."""
    b = F.floor(F.unix_micros("price_at") / QUARTER)
    near = bars.filter(F.col("bar_type") == "INTRADAY").select(
        "ticker", F.explode(F.array(b - 1, b, b + 1)).alias("_bucket15"),
        F.struct("price_at", "close", "source").alias("_m"),
    )
    return near.groupBy("ticker", "_bucket15").agg(F.collect_set("_m").alias("_near"))


def asof_nearest(
    rows: DataFrame, bars: DataFrame, target: str, *, measured: DataFrame | None = None, **limits
) -> DataFrame:
    """Adds ``nearest``: the completed minute closest to ``target`` within 15 minutes.

    Ties prefer the minute at or after the target. One equi-join on (ticker,
    quarter hour); the choice is an array minimum.
    """
    bucket = F.floor(F.unix_micros(target) / QUARTER)
    keyed = rows.withColumn("_bucket15", bucket)
    if measured is not None:
        measured = measured.withColumn("_bucket15", bucket)
    joined = attach(keyed, quarter_hours(bars), ["ticker", "_bucket15"], measured=measured, **limits)
    t = F.unix_micros(target)

    def ranked(m: Column) -> Column:
        at = F.unix_micros(m["price_at"])
        return F.struct(F.abs(at - t).alias("gap"), (at < t).alias("before"), m.alias("bar"))

    best = F.array_min(F.filter(F.transform("_near", ranked), lambda r: r["gap"] <= QUARTER))
    return joined.withColumn("nearest", best["bar"]).drop("_bucket15", "_near")


def session_closes(bars: DataFrame) -> DataFrame:
    return (
        bars.filter(F.col("bar_type") == "DAILY_CLOSE")
        .groupBy("ticker", "session_date")
        .agg(
            F.max_by(F.struct("price_at", "close", "source"), F.struct("bar_at", "bar_id")).alias("_close")
        )
    )


def benchmark_days(bars: DataFrame, rules: OutcomeRules) -> DataFrame:
    """Sessions with a benchmark close; one row per session, so broadcastable."""
    return (
        bars.filter((F.col("ticker") == rules.benchmark) & (F.col("bar_type") == "DAILY_CLOSE"))
        .select(F.col("session_date").alias("target_date"))
        .distinct()
        .withColumn("has_benchmark", F.lit(True))
    )


def session_offset_close(
    rows: DataFrame,
    bars: DataFrame,
    calendar: DataFrame,
    rules: OutcomeRules,
    *,
    measured: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """Adds the close ``offset`` sessions later, counted on the calendar, and its status."""
    ahead = calendar.select(
        F.col("session_idx").alias("_target_idx"),
        F.col("session_date").alias("target_date"),
        F.col("close_ts").alias("target_close"),
    )


    def targeted(df: DataFrame) -> DataFrame:
        shifted = df.withColumn("_target_idx", F.col("session_idx") + F.col("offset"))
        return shifted.join(F.broadcast(ahead), "_target_idx", "left")

    keyed = targeted(rows).join(F.broadcast(benchmark_days(bars, rules)), "target_date", "left")
    closes = session_closes(bars).withColumnRenamed("session_date", "target_date")
    measured = None if measured is None else targeted(measured)
    joined = attach(keyed, closes, ["ticker", "target_date"], measured=measured, **limits)
    pending = F.col("target_close").isNull() | (rules.now() < F.col("target_close"))
    status = (
        F.when(pending, "PENDING")
        .when(F.col("has_benchmark").isNull() | F.col("_close").isNull(), "PENDING_DATA")
        .otherwise("MATURED")
    )
    return joined.withColumn("target_status", status).withColumn(
        "target_bar", F.when(F.col("target_status") == "MATURED", F.col("_close"))
    ).drop("_target_idx", "target_date", "target_close", "has_benchmark", "_close")


def with_hold_path(rows: DataFrame, table: DataFrame, **limits) -> DataFrame:
    """Adds ``hold_max_drawdown_pct`` over (reference, end] to matured horizon rows.

    Decisions with one reference bar hold along one path, so a path is walked once however many follow it. The
    ends of their horizons cut it into stretches; ``table`` has the bars in blocks.
    """
    path = ["ticker", "_from", "initial"]
    marked = rows.withColumns(
        {"_from": F.unix_micros("reference_at"), "initial": F.col("reference_price"), "_end": F.unix_micros("end_at")}
    )
    order = Window.partitionBy(*path).orderBy("hi")
    ends = marked.filter(F.col("end_at").isNotNull()).select(*path, F.col("_end").alias("hi")).distinct()
    stretches = ends.select(
        *path, "hi", F.greatest(F.col("_from") + 1, F.lag("hi").over(order)).alias("lo"), F.row_number().over(order).alias("part"),
        F.lit(1.0).alias("shares"), F.lit(0.0).alias("cash"),
    ).withColumn("hi", F.col("hi") + 1)
    stretches = staged(stretches, "hold-stretches")
    found = extremes(stretches, table, path, **limits).select(*path, "part", "worst")
    so_far = Window.partitionBy(*path).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    worst = stretches.join(found, [*path, "part"], "left").select(
        *path, (F.col("hi") - 1).alias("_end"), F.coalesce(F.min("worst").over(so_far), F.lit(0.0)).alias("_worst")
    )
    joined = attach(marked, staged(worst, "hold-falls"), [*path, "_end"], **limits)
    held = F.when(F.col("end_at").isNotNull(), F.coalesce("_worst", F.lit(0.0)) * 100.0)
    return joined.select(*rows.columns, held.alias("hold_max_drawdown_pct"))


def matured_rows(
    holdings: DataFrame, bars: DataFrame, calendar: DataFrame, rules: OutcomeRules, **limits
) -> DataFrame:
    """Horizon rows with reference, end bar and status.

    Hot keys are looked for in the holdings themselves, before any lookup.
    """
    target = F.col("decision_at") + F.expr("interval 1 hour")
    holdings = holdings.withColumn("target_1h", target)
    refs = with_reference(holdings, bars, calendar, rules, **limits)
    near = asof_nearest(refs, bars, "target_1h", measured=holdings, **limits)
    dated = holdings.withColumn("session_date", session_date(F.col("decision_at"), rules.zone)).join(
        F.broadcast(_sessions(calendar)), "session_date", "left"
    )
    rows = session_offset_close(
        by_horizon(near), bars, calendar, rules, measured=by_horizon(dated), **limits
    )
    hour = (
        F.when(F.col("target_1h") > F.col("close_ts"), "NOT_APPLICABLE")
        .when(rules.now() < F.col("target_1h"), "PENDING")
        .when(F.col("nearest").isNull(), "PENDING_DATA")
        .otherwise("MATURED")
    )
    is_hour = F.col("horizon") == "1h"
    status = F.when(F.col("reference_status") != "MATURED", F.col("reference_status")).otherwise(
        F.when(is_hour, hour).otherwise(F.col("target_status"))
    )
    chosen = F.when(is_hour, F.col("nearest")).otherwise(F.col("target_bar"))
    done = F.col("status") == "MATURED"
    return (
        rows.withColumn("status", status)
        .withColumn("_end", F.when(done, chosen))
        .withColumn("end_price", F.col("_end.close"))
        .withColumn("end_at", F.col("_end.price_at"))
        .withColumn("price_source", F.col("_end.source"))
        .drop("_end", "nearest", "target_bar", "target_status", "target_1h", "reference_status")
    )


def trades_in_span(rows: DataFrame, trades: DataFrame) -> DataFrame:
    """Fills in (decision, last end] of each decision and holding in ``rows``, day by day.

    For decisions that are replayed; whether they can be is known from ``judge_spans`` without their fills.
    """
    spans = rows.filter(F.col("end_at").isNotNull()).groupBy(*KEY).agg(
        F.first("account_ref").alias("account_ref"),
        F.first("decision_at").alias("decision_at"),
        F.first("reference_price").alias("reference_price"),
        F.first("start_shares").alias("start_shares"),
        F.max("end_at").alias("last_end"),
    )
    spans = spans.withColumn("day", F.explode(F.sequence(F.to_date("decision_at"), F.to_date("last_end"))))
    fills = trades.select(
        "account_ref", "ticker", "side", "quantity", "price", "fees", "trade_time", "seq", F.to_date("trade_time").alias("day")
    )
    joined = spans.join(fills, ["account_ref", "ticker", "day"])
    return joined.filter(
        (F.col("trade_time") > F.col("decision_at")) & (F.col("trade_time") <= F.col("last_end"))
    ).drop("day")


def change() -> Column:
    """What a fill does to the shares held."""
    return F.when(F.col("side") == "SELL", -F.col("quantity")).otherwise(F.col("quantity"))


def signed_fills(moves: DataFrame) -> DataFrame:
    """Fills as changes of shares and cash."""
    sell = F.col("side") == "SELL"
    amount = F.col("quantity") * F.col("price")
    return moves.select(
        *KEY, F.col("trade_time").alias("at"), "seq", change().alias("dq"),
        (F.when(sell, amount).otherwise(-amount) - F.coalesce("fees", F.lit(0.0))).alias("dc"),
    )


ACCOUNT = ("account_ref", "ticker")


def span_marks(rows: DataFrame) -> DataFrame:
    """Where the spans of ``rows`` start and end: a row per decision and holding, and one per end."""
    ended = rows.filter(F.col("end_at").isNotNull())
    start = ended.groupBy(*KEY, "account_ref").agg(F.first("decision_at").alias("at")).withColumn("mark", F.lit("start"))
    end = ended.select(*KEY, "account_ref", F.col("end_at").alias("at")).distinct().withColumn("mark", F.lit("end"))
    return start.unionByName(end)


def sweep(rows: DataFrame, trades: DataFrame, sums: Mapping[str, Column] | None = None, **limits) -> DataFrame:
    """Starts and ends of spans merged with the fills of their account and ticker, with what lies before and after.

    Adds to every row ``before`` (fills so far), ``held`` (their shares) and the prefix sums ``sums``, all of them with the row
    itself, and the next fills after the row that are flawed (``next_flaw``) and of an odd side (``next_odd``). What
    lies in a span is a difference of its end and its start; no span is paired with its fills.
    """
    late = F.coalesce(F.upper("trade_time_source"), F.lit("")) != "BROKER_EXECUTION_TIME"
    none = F.lit(None).cast("string")
    fills = trades.select(
        *ACCOUNT, F.col("trade_time").alias("at"), "seq", none.alias("decision_id"), F.lit("fill").alias("mark"), change().alias("dq"),
        F.when(late, "TRADE_TIME_IS_PROXY").when(F.col("fees").isNull(), "FEES_MISSING").alias("flaw"),
        (~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False))).alias("odd"),
        *[value.alias(name) for name, value in (sums or {}).items()],
    )
    stream = fills.unionByName(span_marks(rows), allowMissingColumns=True).withColumn("pos", F.unix_micros("at"))
    # A mark sees the fills of its own instant.
    fill = F.col("mark") == "fill"
    stream = stream.withColumn("kind", F.when(fill, 0).otherwise(1).cast("long")).withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    stream = staged(stream, "span-stream")
    order = Order(ACCOUNT, "pos", "kind", rest=("seq", "decision_id"))
    counted = {"before": ("sum", F.when(fill, F.lit(1)).otherwise(0).cast("long"), True), "held": ("sum", F.coalesce("dq", F.lit(0.0)), True)}
    counted |= {name: ("sum", F.coalesce(name, F.lit(0.0)), True) for name in (sums or {})}
    seen = running(with_chunks(stream, order, **limits), order, {f"_{name}": how for name, how in counted.items()})
    seen = drop_chunks(seen).drop(*(sums or {})).withColumnsRenamed({f"_{name}": name for name in counted})
    back = seen.withColumn("_pos", -F.col("pos")).withColumn("_kind", -F.col("kind")).withColumn("_seq", -F.col("seq"))
    back = staged(back, "span-counts")
    order = Order(ACCOUNT, "_pos", "_kind", rest=("_seq", "decision_id"))
    pointers = {
        "next_flaw": ("last", F.when(F.col("flaw").isNotNull(), F.struct("pos", "flaw")), False),
        "next_odd": ("last", F.when(F.col("odd"), F.struct("pos", "before")), False),
    }
    return drop_chunks(running(with_chunks(back, order, **limits), order, pointers)).drop("_pos", "_kind", "_seq")


def lowest(ranges: DataFrame, swept: DataFrame, **limits) -> DataFrame:
    """Adds ``least``, the fewest shares held after the fills numbered ``first`` to ``last`` of the account and ticker.

    From blocks of 1, 8, 64, ... fills: a range is a handful of them.
    """
    numbered = swept.filter(F.col("mark") == "fill").select(*ACCOUNT, "before", "held")
    size = F.pow(F.lit(RADIX), F.col("level")).cast("long")
    sized = numbered.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(SIZES)])))
    blocks_ = sized.groupBy(*ACCOUNT, "level", F.floor(F.col("before") / size).cast("long").alias("block")).agg(F.min("held").alias("_least"))
    pieces = ranges.select(*KEY, "account_ref", "_end", F.explode(F.concat(*units(F.col("first"), F.col("last") + 1))).alias("_b"))
    pieces = pieces.select(*KEY, "account_ref", "_end", "_b.*")
    found = attach(pieces, blocks_, [*ACCOUNT, "level", "block"], how="inner", **limits)
    least = found.groupBy(*KEY, "_end").agg(F.min("_least").alias("least"))
    return ranges.join(least, [*KEY, "_end"], "left")


def judge_spans(rows: DataFrame, trades: DataFrame, **limits) -> DataFrame:
    """Per horizon row with fills: how many, and why no exact result is possible (NULL if it is).

    Flaws of time and fees count before any replay; in a replay the first fill that can't be followed ends it.
    """
    swept = staged(sweep(rows, trades, **limits), "swept-spans")
    start = swept.filter(F.col("mark") == "start").select(
        *KEY, "account_ref", F.col("before").alias("_before"), F.col("held").alias("_held"), "next_flaw", "next_odd"
    )
    end = swept.filter(F.col("mark") == "end").select(*KEY, F.col("pos").alias("_end"), F.col("before").alias("_until"))
    spans = end.join(start, list(KEY)).withColumn("fills", F.col("_until") - F.col("_before")).filter("fills > 0")
    odd = F.coalesce(F.col("next_odd.pos") <= F.col("_end"), F.lit(False))
    spans = spans.withColumn("odd", odd).withColumn("first", F.col("_before") + 1)
    spans = staged(spans.withColumn("last", F.when(F.col("odd"), F.col("next_odd.before") - 1).otherwise(F.col("_until"))), "judged-spans")
    spans = lowest(spans, swept, **limits)
    facts = rows.filter(F.col("end_at").isNotNull()).select(*KEY, "horizon", "end_at", "start_shares", F.unix_micros("end_at").alias("_end"))
    shares = F.col("start_shares")
    note = (
        F.when(shares.isNull() | (shares <= 0), "START_SHARES_MISSING")
        .when(F.col("next_flaw.pos") <= F.col("_end"), F.col("next_flaw.flaw"))
        .when(shares + F.col("least") - F.col("_held") < 0, "SOLD_MORE_THAN_HELD")
        .when(F.col("odd"), "UNSUPPORTED_SIDE")
    )
    return facts.join(spans, [*KEY, "_end"]).select(*KEY, "horizon", "end_at", "fills", note.alias("actual_note"))


def replay_values(rows: DataFrame, fills: DataFrame, table: DataFrame, judged: DataFrame, **limits) -> DataFrame:
    """End value and worst fall of every exactly replayable horizon row.

    Between two fills value is ``shares * price + cash``: fills and ends cut the path into stretches, whose falls
    come from the blocks of ``table``. A fill counts from its own instant on; the end's price closes the path.
    """
    exact = judged.filter(F.col("actual_note").isNull()).select(*KEY, "horizon", "end_at")
    prices = rows.select(*KEY, "horizon", "end_price")
    exact = exact.join(prices, [*KEY, "horizon"])
    last = exact.groupBy(*KEY).agg(F.max("end_at").alias("last_end"))
    facts = rows.select(*KEY, "start_shares", "reference_price", "reference_at").distinct()
    spans = last.join(facts, list(KEY)).withColumn("_first", F.unix_micros("reference_at") + 1)
    none = F.lit(0.0)

    def cut(df: DataFrame, at: Column, kind: int, seq: Column, dq: Column, dc: Column) -> DataFrame:
        return df.select(
            *KEY, "start_shares", "reference_price", at.alias("lo"), F.lit(kind).alias("kind"), seq.alias("seq"),
            dq.alias("dq"), dc.alias("dc"),
        )

    zero = F.lit(0).cast("long")
    moves = fills.join(spans, list(KEY)).filter(F.col("at") <= F.col("last_end"))
    moves = cut(moves, F.greatest(F.unix_micros("at"), F.col("_first")), 2, F.col("seq"), F.col("dq"), F.col("dc"))
    ends = exact.select(*KEY, "end_at").distinct().join(spans, list(KEY))
    timeline = (
        cut(spans, F.col("_first"), 0, zero, none, none)
        .unionByName(cut(ends, F.unix_micros("end_at") + 1, 1, zero, none, none))
        .unionByName(moves)
    )
    order = Window.partitionBy(*KEY).orderBy("lo", "kind", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    timeline = timeline.select(
        *KEY, "kind", "lo", F.lead("lo").over(order).alias("hi"), F.row_number().over(order).alias("part"),
        (F.col("start_shares") + F.sum("dq").over(upto)).alias("shares"), F.sum("dc").over(upto).alias("cash"),
        (F.col("start_shares") * F.col("reference_price")).alias("initial"),
    )
    timeline = staged(timeline, "replay-stretches")
    found = extremes(timeline, table, KEY, **limits).select(*KEY, "part", "worst", "peak")
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at_ends = timeline.join(found, [*KEY, "part"], "left").select(
        *KEY, "kind", (F.col("lo") - 1).alias("_end"), "shares", "cash",
        F.coalesce(F.min("worst").over(before), none).alias("worst"),
        F.greatest("initial", F.max("peak").over(before)).alias("peak"),
    ).filter(F.col("kind") == 1)
    value = F.col("shares") * F.col("end_price") + F.col("cash")
    return exact.withColumn("_end", F.unix_micros("end_at")).join(at_ends, [*KEY, "_end"]).select(
        *KEY, "horizon", value.alias("end_value"), F.least("worst", value / F.col("peak") - 1.0).alias("worst")
    )


def with_actual(rows: DataFrame, judged: DataFrame, replayed: DataFrame) -> DataFrame:
    """Adds actual return, drawdown, relation and note per horizon row."""
    at = [*KEY, "horizon"]
    joined = rows.join(judged.drop("end_at"), at, "left").join(replayed, at, "left")
    has, done = F.col("fills").isNotNull(), F.col("end_at").isNotNull()
    exact = has & F.col("actual_note").isNull()
    start_value = F.col("start_shares") * F.col("reference_price")
    return (
        joined.withColumn(
            "relation", F.when(~done, "NOT_MATURE").when(has, "TRADED_AFTER").otherwise("NO_TRADE")
        )
        .withColumn(
            "actual_return_pct",
            F.when(exact, (F.col("end_value") / start_value - 1.0) * 100.0)
            .when(done & ~has, F.col("hold_return_pct")),
        )
        .withColumn(
            "actual_max_drawdown_pct",
            F.when(exact, F.least(F.col("worst"), F.lit(0.0)) * 100.0)
            .when(done & ~has, F.col("hold_max_drawdown_pct")),
        )
        .drop("fills", "end_value", "worst")
    )


def score(rows: DataFrame, rules: OutcomeRules) -> DataFrame:
    """Hold and advice returns; the advice pays costs on the exposure it changes."""
    hold = (F.col("end_price") / F.col("reference_price") - 1.0) * 100.0
    cost = F.abs(1.0 - F.col("exposure")) * rules.cost_bps / 100.0
    return rows.withColumn("hold_return_pct", hold).withColumn(
        "advice_return_pct", F.col("exposure") * F.col("hold_return_pct") - cost
    )


def final_status(rows: DataFrame) -> DataFrame:
    partial = (F.col("status") == "MATURED") & (
        F.col("exposure").isNull() | F.col("actual_return_pct").isNull()
    )
    return rows.withColumn("status", F.when(partial, "MATURED_PARTIAL").otherwise(F.col("status")))


def replayed_fills(rows: DataFrame, trades: DataFrame, judged: DataFrame) -> DataFrame:
    """Fills of the horizon rows that can be replayed, as changes of shares and cash."""
    exact = judged.filter(F.col("actual_note").isNull()).select(*KEY, "horizon")
    return signed_fills(trades_in_span(rows.join(exact, [*KEY, "horizon"], "left_semi"), trades))


def learnt_fills(trades: DataFrame, rules: OutcomeRules) -> DataFrame:
    """Fills executed, received and parsed by ``as_of``: one learnt later changes no outcome of that time."""
    return visible_as_of(trades, rules.now(), "trade_time", "received_at", "parsed_at")


def seen_bars(bars: DataFrame, rules: OutcomeRules) -> DataFrame:
    """Bars of times up to ``as_of`` that were collected by then, whole minutes only."""
    seen = visible_as_of(bars, rules.now(), "bar_at", "collected_at")
    return seen.filter((F.col("bar_type") != "INTRADAY") | (F.col("collected_at") >= F.col("price_at")))


def learnt_too_early(trades: DataFrame) -> DataFrame:
    """Fills parsed before they were received, or without one of the two times: a violation each."""
    fine = F.coalesce(F.col("parsed_at") >= F.col("received_at"), F.lit(False))
    return trades.filter(~fine).withColumn("rule", F.lit("PARSED_BEFORE_RECEIPT"))


def outcomes(
    log: DataFrame, bars: DataFrame, trades: DataFrame, calendar: DataFrame, rules: OutcomeRules, **limits
) -> DataFrame:
    """Outcome rows: one per decision, holding and horizon. ``bars`` must be deduplicated.

    Only what was known at ``as_of`` counts: log entries, bars and fills are filtered here by event and learn time.
    """
    bars, trades = seen_bars(bars, rules), learnt_fills(trades, rules)
    table = staged(blocks(bars), "price-blocks")
    holdings = staged(decision_holdings(decision_delivery(log, rules), rules), "holdings")
    # Several joins read the results of the lookups: write them once.
    rows = staged(score(matured_rows(holdings, bars, calendar, rules, **limits), rules), "matured")
    rows = staged(with_hold_path(rows, table, **limits), "held")
    judged = staged(judge_spans(rows, trades, **limits), "judged")
    fills = staged(replayed_fills(rows, trades, judged), "fills")
    return final_status(with_actual(rows, judged, replay_values(rows, fills, table, judged, **limits)))


def outcome_table(scored: DataFrame, rules: OutcomeRules, digest: DataFrame) -> DataFrame:
    """The outcome table as it is written: 22 columns of text, numbers with eight digits, missing ones empty.

    ``digest`` is the one-row fingerprint of the inputs.
    """

    def instant(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(""))

    start = F.when(F.col("delivered_at").isNull(), "NOT_DELIVERED").when(
        F.col("reference_price").isNotNull(), "FROM_FIRST_WHOLE_MINUTE"
    ).when(F.col("status") == "PENDING", "REFERENCE_PENDING").otherwise("REFERENCE_MISSING")
    done = F.col("end_at").isNotNull()
    notes = F.array(
        start, F.when(done & F.col("exposure").isNull(), "EXPOSURE_MISSING"), F.when(done, F.col("actual_note"))
    )
    rows = scored.select(
        "decision_id",
        "ticker",
        instant("decision_at").alias("decision_at"),
        F.coalesce("market_phase", F.lit("UNCONFIRMED")).alias("market_phase"),
        F.col("action").alias("advice_action"),
        F.col("relation").alias("user_event_relation"),
        F.col("horizon").alias("outcome_horizon"),
        F.col("status").alias("outcome_status"),
        fmt_outcome(F.col("actual_return_pct")).alias("actual_return_pct"),
        fmt_outcome(F.col("hold_return_pct")).alias("hold_return_pct"),
        fmt_outcome(F.col("advice_return_pct")).alias("advice_counterfactual_return_pct"),
        fmt_outcome(F.col("actual_max_drawdown_pct")).alias("actual_max_drawdown_pct"),
        fmt_outcome(F.col("hold_max_drawdown_pct")).alias("hold_max_drawdown_pct"),
        F.lit(f"{rules.cost_bps:.2f} bps on changed exposure").alias("transaction_cost_assumption"),
        fmt_outcome(F.col("reference_price")).alias("reference_price"),
        instant("reference_at").alias("reference_price_at"),
        fmt_outcome(F.col("end_price")).alias("end_price"),
        instant("end_at").alias("end_price_at"),
        F.coalesce("price_source", F.lit("")).alias("price_source"),
        F.concat_ws(";", F.filter(notes, lambda n: n.isNotNull())).alias("notes"),
        F.date_format(rules.now(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("calculated_at"),
    )
    return stamp(rows, digest)
