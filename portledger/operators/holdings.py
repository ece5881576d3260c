"""Holding facts, actions, portfolio weights and value snapshots per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.functions.columns import clean_ticker, optional_float, safe_float
from portledger.operators.market import technical_state
from portledger.operators.skew import attach


def holding_facts(holdings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Latest price, value, weight and P&L of every holding of every account.

    The account total is a partial aggregate joined back with hot accounts
    salted, not a window over the account.
    """
    h = holdings.withColumn("ticker", clean_ticker(F.col("ticker"))).filter(F.col("ticker") != "")
    h = h.select(
        "account_ref", "ticker",
        *[
            safe_float(F.col(c)).alias(c)
            for c in ("shares", "avg_cost", "last_price", "market_value", "portfolio_weight_pct")
        ],
        *[optional_float(F.col(c)).alias(c) for c in ("stop_loss_pct", "trim_profit_pct")],
    ).withColumnsRenamed({"market_value": "given_value", "portfolio_weight_pct": "given_weight"})
    latest = F.coalesce("close", "last_price")
    valued = h.join(metrics, "ticker", "left").withColumn("latest", latest).withColumn(
        "value",
        F.when(F.col("given_value") > 0, F.col("given_value")).otherwise(
            F.col("shares") * F.col("latest")
        ),
    )
    totals = valued.groupBy("account_ref").agg(F.sum("value").alias("total_value"))
    joined = attach(valued, totals, ["account_ref"])
    weight = F.when(
        F.col("total_value") != 0, F.col("value") / F.col("total_value") * 100.0
    ).otherwise(F.col("given_weight"))
    pnl = F.when(
        (F.col("avg_cost") != 0) & (F.col("latest") != 0),
        (F.col("latest") / F.col("avg_cost") - 1.0) * 100.0,
    )
    return (
        joined.withColumn("weight_pct", weight)
        .withColumn("pnl_pct", pnl)
        .withColumn("missing_value", (F.col("value") <= 0) & (F.col("given_weight") <= 0))
        .withColumn("missing_cost", F.col("avg_cost") <= 0)
    )


def holding_action(regime: Column) -> Column:
    """One action per holding; the first rule that applies decides, weight never does."""
    c = F.col
    state = technical_state()
    return (
        F.when(c("close").isNull(), "WATCH")
        .when(c("pnl_pct") <= c("stop_loss_pct"), "SELL_REVIEW")
        .when((state == "INSUFFICIENT_DATA") | (regime == "INSUFFICIENT_DATA"), "WATCH")
        .when((c("sma_200_gap_pct") < -5) & (c("rel_spy_60d_pct") < -5), "WATCH")
        .when((c("pnl_pct") >= c("trim_profit_pct")) & (c("rsi_14") >= 75), "TRIM")
        .when(
            (regime == "RISK_OFF") & (c("ret_20d_pct") < 0) & (c("rel_spy_20d_pct") < 0), "WATCH"
        )
        .when(
            (regime == "RISK_ON")
            & (state == "HEALTHY")
            & (c("rsi_14") < 70)
            & (c("vol_30d_ann_pct").isNull() | (c("vol_30d_ann_pct") <= 100)),
            "ADD",
        )
        .otherwise("HOLD")
    )


def with_actions(facts: DataFrame, regime_row: DataFrame) -> DataFrame:
    """Adds state and action; the one-row regime enters as a scalar subquery."""
    regime = regime_row.select("regime").scalar()
    return facts.withColumn("state", technical_state()).withColumn("action", holding_action(regime))


def position_snapshot(facts: DataFrame) -> DataFrame:
    """Snapshot rows: value, cost and P&L; cost stays NULL where the average cost is unknown."""
    cost = F.when(F.col("avg_cost") != 0, F.col("shares") * F.col("avg_cost"))
    value = F.col("shares") * F.col("close")
    return facts.select(
        "account_ref",
        F.col("price_as_of").alias("snapshot_date"),
        "ticker", "shares", "avg_cost",
        F.col("close").alias("last_price"),
        value.alias("market_value"),
        cost.alias("cost_basis"),
        (value - cost).alias("unrealized_pnl"),
        ((value - cost) / F.when(cost != 0, cost) * 100.0).alias("unrealized_pnl_pct"),
    )


def snapshot_guard(facts: DataFrame) -> DataFrame:
    """Per account: may the snapshot be written, and if not why (all or nothing)."""
    return facts.groupBy("account_ref").agg(
        F.count(F.lit(1)).alias("holdings"),
        F.count_if(F.col("shares") <= 0).alias("no_shares"),
        F.count_if(F.col("close").isNull() | F.col("price_as_of").isNull()).alias("no_price"),
        F.min("price_as_of").alias("_first"),
        F.max("price_as_of").alias("_last"),
    ).select(
        "account_ref", "holdings",
        F.when(F.col("no_shares") > 0, "SHARES_UNCONFIRMED")
        .when(F.col("no_price") > 0, "PRICE_MISSING")
        .when(F.col("_first") != F.col("_last"), "MIXED_PRICE_DATES")
        .otherwise("WRITE")
        .alias("decision"),
        F.when(F.col("_first") == F.col("_last"), F.col("_first")).alias("snapshot_date"),
    )


def snapshot_rows(facts: DataFrame) -> DataFrame:
    """Snapshot rows of the accounts that pass the guard."""
    passed = snapshot_guard(facts).filter(F.col("decision") == "WRITE").select("account_ref")
    return attach(position_snapshot(facts), passed, ["account_ref"], how="left_semi")


def replace_slice(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows outside the slices the new rows cover, plus the new rows."""
    slices = new.select(*keys).distinct()
    return existing.join(slices, keys, "left_anti").unionByName(new)


def value_by_date(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("account_ref", "snapshot_date").agg(
        F.sum("market_value").alias("total_value")
    )


def composition(snapshots: DataFrame) -> DataFrame:
    """Order-free digest of the (ticker, shares) multiset of each account and date.

    Sums of row hashes need no list of the rows, so an account of any size
    aggregates before the shuffle.
    """
    row = [F.upper(F.trim("ticker")), F.col("shares").cast("double")]
    return snapshots.groupBy("account_ref", "snapshot_date").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("_h1"),
        F.sum(F.hash(*row).cast("long")).alias("_h2"),
    )


def composition_constant(snapshots: DataFrame) -> DataFrame:
    return composition(snapshots).groupBy("account_ref").agg(
        F.count(F.lit(1)).alias("dates"),
        (
            (F.min("members") == F.max("members"))
            & (F.min("_h1") == F.max("_h1"))
            & (F.min("_h2") == F.max("_h2"))
        ).alias("constant"),
    )


def snapshot_drawdown(snapshots: DataFrame) -> DataFrame:
    """Current and worst drawdown of the daily value, where the composition never changed.

    After the daily aggregation an account has one row per date, so its window
    is bounded by the calendar.
    """
    daily = value_by_date(snapshots)
    w = Window.partitionBy("account_ref").orderBy("snapshot_date")
    fall = daily.withColumn(
        "dd", F.col("total_value") / F.max("total_value").over(w) - 1.0
    ).groupBy("account_ref").agg(
        (F.max_by("dd", "snapshot_date") * 100.0).alias("current_dd"),
        (F.min("dd") * 100.0).alias("max_dd"),
    )
    usable = F.col("constant") & (F.col("dates") >= 2)
    return composition_constant(snapshots).join(fall, "account_ref").select(
        "account_ref", "dates",
        F.when(~F.col("constant"), "COMPOSITION_CHANGED")
        .when(F.col("dates") < 2, "TOO_FEW_DATES")
        .otherwise("OK")
        .alias("status"),
        F.when(usable, F.col("current_dd")).alias("current_drawdown_pct"),
        F.when(usable, F.col("max_dd")).alias("max_drawdown_pct"),
    )


def price_date_guard(facts: DataFrame) -> DataFrame:
    """Is every holding of an account priced on one date (minimum equals maximum)."""
    return facts.groupBy("account_ref").agg(
        F.min("price_as_of").alias("first_date"),
        F.max("price_as_of").alias("last_date"),
        (F.min("price_as_of") == F.max("price_as_of")).alias("one_date"),
    )


def ticker_union(*sources: DataFrame) -> DataFrame:
    """Distinct clean tickers of several sources."""
    cleaned = [
        s.select(clean_ticker(F.col("ticker")).alias("ticker")).filter(F.col("ticker") != "")
        for s in sources
    ]
    out = cleaned[0]
    for other in cleaned[1:]:
        out = out.union(other)
    return out.distinct()
