"""Average-cost replay of fills into positions, for accounts of any size.

Between two fills cost is affine: a buy adds ``q*p + fees``, a sell keeps the
average, so ``C_out = a*C_in + b`` with ``a = Q_after / Q_before``; realised P&L
is linear in ``C_in`` too. Such steps compose associatively, so a position is a
reduction of one small struct per fill:

1. running quantity per (account, ticker) by a chunked scan (exact decimals);
2. one step struct per fill, reduced in runs of at most ``RUN`` fills, then per
   chunk, then per position.

No list is ever longer than ``RUN`` steps, the runs of one chunk or the chunks
of one position, whatever the share of rows one account holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portledger.functions.columns import valid_ticker
from portledger.operators.scans import DAY, Order, running, with_chunks
from portledger.sources.staging import staged

KEYS = ("account_ref", "ticker")
RUN = 4096
BIG = "decimal(38,8)"

def broker_rules(trades: DataFrame) -> DataFrame:
    """Adds ``rule``, the first rule of the broker contract that a fill breaks; NULL where it holds all.

    Nothing is guessed: a side, currency, ticker, time or amount that isn't known to be right refuses the fill.
    """
    reward = F.col("event_type") == "STOCK_REWARD"
    side = F.upper(F.trim("side"))
    sides = F.when(reward, side == "CREDIT").when(F.col("event_type") == "TRADE", side.isin("BUY", "SELL"))

    def known(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    rule = (
        F.when(F.col("trade_time").isNull(), "TRADE_TIME_MISSING")
        .when(~known(F.col("event_type").isin("TRADE", "STOCK_REWARD")), "UNSUPPORTED_EVENT_TYPE")
        .when(~known(sides), "UNSUPPORTED_SIDE")
        .when(~valid_ticker(F.upper(F.trim("ticker"))), "INVALID_TICKER")
        .when(~known(F.upper(F.trim("currency")) == "USD"), "NON_USD")
        .when(~known(F.col("quantity") > 0), "BAD_QUANTITY")
        .when(~reward & ~known(F.col("price") > 0), "BAD_PRICE")
        .when(~reward & (F.col("fees") < 0), "BAD_FEES")
    )
    return trades.withColumn("rule", rule)


#: What a replay reads of a judged fill.
REPLAYED = (*KEYS, "event_type", "side", "quantity", "price", "fees", "trade_time", "seq", "company_name", "l_partkey", "l_suppkey", "rule")


def replay(trades: DataFrame, anchors: DataFrame | None = None, **limits) -> DataFrame:
    """Positions from fills under the broker contract, and how many fills of a position were refused.

    A position with a refused fill has no quantity, cost or result: what it holds isn't known.
    """
    judged = broker_rules(trades)
    judged = staged(judged.select(*[c for c in judged.columns if c in REPLAYED]), "judged-fills")
    anchors = None if anchors is None else staged(anchors, "anchors")
    fine = judged.filter(F.col("rule").isNull()).drop("rule")
    fine = fine.withColumn("side", F.upper(F.trim("side"))).withColumn("ticker", F.upper(F.trim("ticker")))
    # Fills in one shape are a projection of the judged ones: they aren't written a second time.
    found = fold(prepare(fine, anchors), **limits)
    refused = judged.filter(F.col("rule").isNotNull()).groupBy("account_ref", F.upper(F.trim("ticker")).alias("ticker")).agg(
        F.count(F.lit(1)).alias("refused"), F.min("rule").alias("first_rule")
    )
    both = found.join(refused, list(KEYS), "full").withColumn("refused", F.coalesce("refused", F.lit(0).cast("long")))
    known = F.col("refused") == 0
    return both.select(
        *[c if c in (*KEYS, "refused", "first_rule") else F.when(known, F.col(c)).alias(c) for c in both.columns]
    )


def prepare(trades: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Fills (and opening positions, as fills of their own) in one shape.

    Only fills after the anchor time of their position count.
    """
    fills = trades.select(
        *KEYS,
        F.col("event_type"),
        F.col("side"),
        F.col("quantity").cast(BIG).alias("quantity"),
        F.col("price").cast("double").alias("price"),
        F.col("fees").cast("double").alias("fees"),
        F.col("trade_time"),
        F.col("seq").cast("long").alias("seq"),
        company(trades),
        *[c for c in ("l_partkey", "l_suppkey") if c in trades.columns],
    )
    if anchors is not None:
        bounds = anchors.select(*KEYS, F.col("anchor_at").alias("_after"))
        fills = (
            fills.join(bounds, list(KEYS), "left")
            .filter(F.col("_after").isNull() | (F.col("trade_time") > F.col("_after")))
            .drop("_after")
        )
        opening = anchors.select(
            *KEYS,
            F.lit("ANCHOR").alias("event_type"),
            F.lit("OPEN").alias("side"),
            F.col("shares").cast(BIG).alias("quantity"),
            F.col("avg_cost").cast("double").alias("price"),
            F.lit(None).cast("double").alias("fees"),
            F.col("anchor_at").alias("trade_time"),
            F.lit(-1).cast("long").alias("seq"),
            company(anchors),
            F.col("entry_date").alias("entry_date"),
        )
        fills = fills.unionByName(opening, allowMissingColumns=True)
    else:
        fills = fills.withColumn("entry_date", F.lit(None).cast("date"))
    gains = F.col("side").isin("BUY", "CREDIT", "OPEN")
    # Any other side has no sign: it must have been refused before.
    signed = F.when(F.col("side") == "SELL", -F.col("quantity")).when(gains, F.col("quantity"))
    signed = F.coalesce(signed, F.raise_error(F.concat(F.lit("fill without a known side or quantity: "), F.coalesce(F.col("seq").cast("string"), F.lit("?")))))
    return fills.withColumn("pos", F.unix_micros("trade_time")).withColumn("signed", signed.cast(BIG))


def company(df: DataFrame) -> Column:
    """The company name, NULL where it is empty or the table has none."""
    name = F.trim("company_name") if "company_name" in df.columns else F.lit(None).cast("string")
    return F.when(name != "", name).alias("company_name")


def order_of(fills: DataFrame, width: int = 30 * DAY) -> Order:
    rest = tuple(c for c in ("l_partkey", "l_suppkey") if c in fills.columns)
    return Order(KEYS, "pos", "seq", width, (*rest, "signed", "price"))


def running_quantity(fills: DataFrame, order: Order | None = None, **limits) -> DataFrame:
    """Adds ``held_after``, ``held_before`` and ``_rn`` (rank in chunk), keeping the chunks."""
    order = order or order_of(fills)
    chunked = with_chunks(fills, order, **limits)
    out = running(chunked, order, {"held_after": ("sum", F.col("signed"), True)}, row_number="_rn")
    return out.withColumn("held_before", F.col("held_after") - F.col("signed"))


def oversold(fills: DataFrame, **limits) -> DataFrame:
    """First sell per position that exceeds the quantity then held."""
    rows = running_quantity(fills, **limits)
    bad = rows.filter((F.col("side") == "SELL") & (F.col("held_after") < 0))
    first = F.struct("pos", "seq", "signed", "price")
    return bad.groupBy(*KEYS).agg(
        F.min_by(
            F.struct("seq", "trade_time", "quantity", F.col("held_before").alias("held")), first
        ).alias("_v")
    ).select(*KEYS, "_v.*")


def _step() -> Column:
    """One fill as a step: what it does to any incoming cost and flags."""
    sell = F.col("side") == "SELL"
    anchor = F.col("event_type") == "ANCHOR"
    blind = (F.col("event_type") == "STOCK_REWARD") | (anchor & F.col("price").isNull())
    q = F.col("quantity").cast("double")
    before, after = F.col("held_before").cast("double"), F.col("held_after").cast("double")
    closes = sell & (F.col("held_after") == 0)
    fees = F.coalesce("fees", F.lit(0.0))
    opened = F.when(
        ~sell & (F.col("held_before") == 0), F.coalesce("entry_date", F.to_date("trade_time"))
    )
    paid = F.when(sell | blind, 0.0).when(anchor, q * F.col("price")).otherwise(
        q * F.col("price") + fees
    )
    return F.struct(
        F.when(closes, 0.0).when(sell, after / F.nullif(before, F.lit(0.0))).otherwise(1.0).alias("a"),
        paid.alias("b"),
        F.when(sell, -q / F.nullif(before, F.lit(0.0))).otherwise(0.0).alias("ra"),
        F.when(sell, q * F.col("price") - fees).otherwise(0.0).alias("rb"),
        F.when(closes, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("resets"),
        (blind & ~closes).alias("reward"),
        ((F.col("fees").isNull() | (F.col("event_type") != "TRADE")) & ~closes).alias("fee_gap"),
        sell.alias("sell_first"),
        F.lit(False).alias("sell_blind"),
        (sell & F.col("fees").isNull()).alias("sell_fee_gap"),
        F.when(~closes, opened).alias("entry"),
        F.col("signed").cast(BIG).alias("shares"),
        F.when(anchor, 0).otherwise(1).cast("long").alias("applied"),
        (sell & (F.col("held_after") < 0)).alias("oversold"),
        F.col("company_name").alias("company"),
        F.struct("pos", "seq").alias("seen"),
    )


def _identity_parts() -> dict[str, Column]:
    return {
        **{c: F.lit(v) for c, v in (("a", 1.0), ("b", 0.0), ("ra", 0.0), ("rb", 0.0))},
        "resets": F.lit(0).cast("long"),
        **{c: F.lit(False) for c in ("reward", "fee_gap", "sell_first", "sell_blind", "sell_fee_gap")},
        "entry": F.lit(None).cast("date"),
        "shares": F.lit(0).cast(BIG),
        "applied": F.lit(0).cast("long"),
        "oversold": F.lit(False),
        "company": F.lit(None).cast("string"),
        "seen": F.lit(None).cast("struct<pos:bigint,seq:bigint>"),
    }


def _identity() -> Column:
    return F.struct(*[part.alias(c) for c, part in _identity_parts().items()])


def _ordered(x: Column, y: Column) -> dict[str, Column]:
    """Cost and flags of the step ``x`` followed by the step ``y``."""
    fresh = y["resets"] > 0
    return {
        "a": y["a"] * x["a"],
        "b": y["a"] * x["b"] + y["b"],
        "ra": x["ra"] + y["ra"] * x["a"],
        "rb": x["rb"] + y["rb"] + y["ra"] * x["b"],
        "resets": x["resets"] + y["resets"],
        "reward": y["reward"] | (~fresh & x["reward"]),
        "fee_gap": y["fee_gap"] | (~fresh & x["fee_gap"]),
        # A sell whose cost knowledge still depends on what came before x.
        "sell_first": x["sell_first"] | ((x["resets"] == 0) & ~x["reward"] & y["sell_first"]),
        "sell_blind": x["sell_blind"] | y["sell_blind"] | (x["reward"] & y["sell_first"]),
        "entry": F.when(fresh, y["entry"]).otherwise(F.coalesce(x["entry"], y["entry"])),
    }


def _then(x: Column, y: Column) -> Column:
    """The step ``x`` followed by the step ``y``."""
    parts = {
        **_ordered(x, y),
        "sell_fee_gap": x["sell_fee_gap"] | y["sell_fee_gap"],
        "shares": (x["shares"] + y["shares"]).cast(BIG),
        "applied": x["applied"] + y["applied"],
        "oversold": x["oversold"] | y["oversold"],
        "company": F.coalesce(y["company"], x["company"]),
        "seen": F.coalesce(x["seen"], y["seen"]),
    }
    return F.struct(*[parts[c].alias(c) for c in _identity_parts()])


def _reduce(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    packed = steps.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, "step"))).alias("_s")
    )
    folded = F.aggregate("_s", _identity(), lambda acc, s: _then(acc, s["step"]))
    return packed.select(*keys, folded.alias("step"))


#: What a step does to cost and flags, which depends on the steps before it.
ORDERED = ("a", "b", "ra", "rb", "resets", "reward", "fee_gap", "sell_first", "sell_blind", "entry")


def _runs(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Single fills reduced to one step per run: sums and firsts by plain aggregates, the rest in order."""
    s, rn = F.col("step"), F.col("_rn")
    packed = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_rn", *[s[c].alias(c) for c in ORDERED]))).alias("_s"),
        F.sum(s["shares"]).cast(BIG).alias("shares"),
        F.sum(s["applied"]).alias("applied"),
        F.bool_or(s["oversold"]).alias("oversold"),
        F.bool_or(s["sell_fee_gap"]).alias("sell_fee_gap"),
        F.max_by(s["company"], F.when(s["company"].isNotNull(), rn)).alias("company"),
        F.min_by(s["seen"], rn).alias("seen"),
    )

    def then(x: Column, y: Column) -> Column:
        return F.struct(*[step.alias(c) for c, step in _ordered(x, y).items()])

    identity = F.struct(*[_identity_parts()[c].alias(c) for c in ORDERED])
    folded = packed.withColumn("_o", F.aggregate("_s", identity, then))
    return folded.select(*keys, F.struct(*[F.col(f"_o.{c}" if c in ORDERED else c).alias(c) for c in _identity_parts()]).alias("step"))


def fold(fills: DataFrame, *, order: Order | None = None, run: int = RUN, **limits) -> DataFrame:
    """Final position per (account, ticker) from prepared fills.

    Positions that were ever oversold are flagged; their costs mean nothing.
    """
    order = order or order_of(fills)
    rows = running_quantity(fills, order, **limits)
    if "company_name" not in rows.columns:
        rows = rows.withColumn("company_name", F.lit(None).cast("string"))
    steps = rows.select(
        *order.chunk, "_rn", F.floor((F.col("_rn") - 1) / run).alias("_run"), _step().alias("step")
    )
    runs = _runs(steps, [*order.chunk, "_run"])
    chunks = _reduce(runs, order.chunk, ["_run"])
    final = _reduce(chunks, list(KEYS), ["_bucket", "_part"])
    s = F.col("step")
    open_ = s["shares"] != 0
    known = ~open_ | ~s["reward"]
    cost = F.when(open_ & known, s["b"])
    complete = ~s["sell_blind"] & ~s["sell_fee_gap"]
    return final.select(
        *KEYS,
        s["shares"].alias("shares"),
        cost.alias("total_cost"),
        (cost / s["shares"].cast("double")).alias("avg_cost"),
        F.when(complete, s["rb"]).alias("realised_pnl"),
        complete.alias("realised_complete"),
        known.alias("cost_known"),
        (~open_ | ~s["fee_gap"]).alias("fees_complete"),
        F.when(open_, s["entry"]).alias("entry_date"),
        s["applied"].alias("applied"),
        s["oversold"].alias("oversold"),
        s["company"].alias("company_name"),
        s["seen"].alias("first_seen"),
    )


def consolidate(positions: DataFrame) -> DataFrame:
    """Accounts summed to one row per ticker; closed positions drop out.

    The company's name is that of the position opened last which has one.
    """
    held = positions.filter(F.col("shares") != 0)
    known = F.bool_and("cost_known")
    return held.groupBy("ticker").agg(
        F.sum("shares").alias("shares"),
        F.when(known, F.sum("total_cost")).alias("total_cost"),
        F.when(known, F.sum("total_cost") / F.sum("shares").cast("double")).alias("avg_cost"),
        known.alias("cost_known"),
        F.bool_and("fees_complete").alias("fees_complete"),
        F.min("entry_date").alias("entry_date"),
        F.count(F.lit(1)).alias("accounts"),
        F.max_by("company_name", F.when(F.col("company_name").isNotNull(), F.struct("first_seen", "account_ref"))).alias("company_name"),
    )


def replay_audit(positions: DataFrame, input_rows: DataFrame) -> DataFrame:
    """One row: counts, realised P&L (NULL unless complete) and lists of flagged tickers.

    The lists hold distinct tickers of the consolidated table, bounded by the
    number of listed securities.
    """
    merged = consolidate(positions)
    rows = input_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    complete = F.bool_and("realised_complete")
    summary = positions.agg(
        F.sum("applied").alias("applied"),
        F.when(complete, F.sum("realised_pnl")).alias("realised_pnl"),
        F.bool_or("oversold").alias("any_oversold"),
    )
    tickers = merged.agg(
        F.count(F.lit(1)).alias("active_tickers"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("cost_known"), F.col("ticker"))))).alias(
            "unknown_cost_tickers"
        ),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("fees_complete"), F.col("ticker"))))).alias(
            "fee_incomplete_tickers"
        ),
    )
    one = summary.select(
        rows.alias("input_rows"), "applied", (rows - F.col("applied")).alias("ignored"),
        "realised_pnl", "any_oversold",
    )
    names = ["active_tickers", "unknown_cost_tickers", "fee_incomplete_tickers"]
    return one.select("*", *[tickers.select(n).scalar().alias(n) for n in names])


def fold_small(fills: DataFrame) -> DataFrame:
    """The same replay as a single ordered fold per position, in exact decimals.

    Only for positions whose fills fit one array: the checkable reference form.
    """
    money = "decimal(30,12)"
    packed = fills.groupBy(*KEYS).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *order_of(fills).columns,
                    "side", "quantity", F.col("fees").alias("fees"), "event_type",
                )
            )
        ).alias("_f")
    )

    def dec(c: Column) -> Column:
        return c.cast(money)

    start = F.struct(
        F.lit(0).cast(BIG).alias("q"), dec(F.lit(0)).alias("cost"), dec(F.lit(0)).alias("realised")
    )

    def step(acc: Column, f: Column) -> Column:
        sell = f["side"] == "SELL"
        q = f["quantity"].cast("decimal(20,8)")
        p, fees = f["price"].cast("decimal(20,8)"), F.coalesce(f["fees"], F.lit(0.0)).cast("decimal(20,8)")
        left = (acc["q"] + F.when(sell, -q).otherwise(q)).cast(BIG)
        avg = F.when(acc["q"] != 0, (acc["cost"].cast("decimal(28,8)") / acc["q"].cast("decimal(20,8)")).cast("decimal(28,12)"))
        return F.struct(
            left.alias("q"),
            dec(
                F.when(sell & (left == 0), dec(F.lit(0)))
                .when(sell, dec(acc["cost"] - dec(q * avg)))
                .otherwise(dec(acc["cost"] + dec(dec(q * p) + fees)))
            ).alias("cost"),
            dec(
                F.when(sell, dec(acc["realised"] + dec(dec(q * (p - avg).cast("decimal(28,12)")) - fees)))
                .otherwise(acc["realised"])
            ).alias("realised"),
        )

    return packed.withColumn("_r", F.aggregate("_f", start, step)).select(
        *KEYS, F.col("_r.q").alias("shares"), F.col("_r.cost").alias("total_cost"),
        F.col("_r.realised").alias("realised_pnl"),
    )
