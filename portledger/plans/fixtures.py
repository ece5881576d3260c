"""Portfolio-shaped views over the given tables.

Each view maps the generic tables (orders, line items, events, ...) onto the
inputs of an operator, so that every query grows with the given data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portledger.operators.scans import Order, drop_chunks, running, with_chunks

# Which supplier plays which market benchmark.
BENCHMARK_SUPPLIERS = {
    "S1": "QQQ",
    "S2": "IWM",
    "S3": "SMH",
    "S4": "SOXX",
    "S5": "IGV",
    "S6": "RSP",
    "S7": "HYG",
    "S8": "IEF",
    "S9": "^VIX",
}

# Which event type plays which candidate state.
EVENT_STATES = {
    "signup": "RESEARCH_QUEUE",
    "view": "WATCHING",
    "click": "NEAR_TRIGGER",
    "purchase": "OPEN_CANDIDATE",
    "error": "PAUSED",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(price: Column) -> Column:
    """A unit price damped to daily moves of a few per cent, to four decimals.

    The tiny shift keeps exact halves from depending on the engine.
    """
    return F.round(500 + 40 * F.ln(price) + 1e-7, 4)


def _bars(items: DataFrame, ticker: str | Column) -> DataFrame:
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    name = F.lit(ticker) if isinstance(ticker, str) else ticker
    return (
        items.select(
            name.alias("ticker"),
            F.to_date("l_shipdate").alias("session_date"),
            "l_extendedprice",
            "l_quantity",
            unit_price.alias("_px"),
        )
        .groupBy("ticker", "session_date")
        .agg(
            _quote(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            _quote(F.max("_px")).alias("high"),
            _quote(F.min("_px")).alias("low"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def fx_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one ticker per supplier; at most one row per ticker and session."""
    return _bars(
        table(spark, sf_dir, "lineitem"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    )


def fx_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the whole market, playing SPY."""
    return _bars(table(spark, sf_dir, "lineitem"), "SPY")


def fx_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPY plus nine suppliers that play the other benchmarks; VIX is scaled to its range."""
    pairs = [F.lit(x) for pair in BENCHMARK_SUPPLIERS.items() for x in pair]
    name = F.element_at(F.create_map(*pairs), F.col("ticker"))
    scale = F.when(name == "^VIX", 0.02).otherwise(1.0)
    others = (
        fx_bars(spark, sf_dir)
        .filter(F.col("ticker").isin(*BENCHMARK_SUPPLIERS))
        .select(
            name.alias("ticker"),
            "session_date",
            *[(F.col(c) * scale).alias(c) for c in ("close", "high", "low")],
            "volume",
        )
    )
    return fx_market(spark, sf_dir).unionByName(others)


def fx_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session dates of the daily bars, numbered; one row per calendar day at most."""
    from portledger.operators.calendars import number_sessions

    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session_date"))
    return number_sessions(days.distinct(), open_hour=14.5, close_hour=21.0)


def fx_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker fills: account by customer, ticker by brand, returned items are sells."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(parts, items.l_partkey == parts.p_partkey)
        .select(
            F.concat(F.lit("A"), (F.col("o_custkey") % 50).cast("string")).alias("account_ref"),
            F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("ticker"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.lit("TRADE").alias("event_type"),
            F.col("l_quantity").cast("decimal(20,8)").alias("quantity"),
            F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-7, 4)
            .cast("decimal(20,8)")
            .alias("price"),
            F.when(F.col("l_tax") != 0, F.round(F.col("l_extendedprice") * F.col("l_tax"), 4))
            .cast("decimal(20,8)")
            .alias("fees"),
            F.col("l_shipdate").cast("timestamp").alias("trade_time"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("execution_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            "l_partkey",
            "l_suppkey",
        )
    )


def fx_broker_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills as brokers report them: rewards, names, and some that break a rule of the contract."""
    fills, n = fx_trades(spark, sf_dir), F.col("seq")
    reward = (n % 499 == 0) | (n % 2111 == 0)
    return fills.select(
        "account_ref",
        F.when(n % 1913 == 0, "no ticker!").otherwise(F.col("ticker")).alias("ticker"),
        F.when(reward, "STOCK_REWARD").otherwise("TRADE").alias("event_type"),
        F.when(n % 2503 == 0, "SHORT")
        .when(reward & (n % 2111 != 0), "CREDIT")
        .when(n % 5 == 0, F.lower("side"))
        .otherwise(F.col("side"))
        .alias("side"),
        F.when(n % 2309 == 0, F.lit(0).cast("decimal(20,8)")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(n % 2017 != 0, F.col("price")).alias("price"),
        "fees",
        F.when(n % 2411 == 0, "HKD").when(n % 2 == 0, " usd").otherwise("USD").alias("currency"),
        F.when(n % 2203 != 0, F.col("trade_time")).alias("trade_time"),
        F.when(n % 3 == 0, F.concat(F.lit("Name "), (n % 5).cast("string"))).when(n % 3 == 1, " ").alias("company_name"),
        "execution_id",
        "seq",
        "l_partkey",
        "l_suppkey",
    )


def fx_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One large opening position per account and ticker, before the first fill."""
    return (
        fx_trades(spark, sf_dir)
        .select("account_ref", "ticker")
        .distinct()
        .select(
            "account_ref",
            "ticker",
            F.lit(20000).cast("decimal(20,8)").alias("shares"),
            F.lit(2000).cast("decimal(20,8)").alias("avg_cost"),
            F.lit("1994-12-30").cast("date").alias("entry_date"),
            F.lit("1995-01-01 00:00:00").cast("timestamp").alias("anchor_at"),
        )
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_ticker() -> Column:
    return F.concat(F.lit("T"), (F.col("user_id") % 2).cast("string"))


def _event_account() -> Column:
    return F.concat(F.lit("A"), (F.col("user_id") % 50).cast("string"))


def fx_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays seen in the events, open all day until 21:00 UTC."""
    from portledger.operators.calendars import number_sessions

    days = _events(spark, sf_dir).select(F.to_date("ts").alias("session_date")).distinct()
    weekdays = days.filter(F.weekday("session_date") < 5)
    return number_sessions(weekdays, open_hour=0.0, close_hour=21.0)


def fx_raw_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-purchase event as one minute observation; minutes may repeat and conflict."""
    start = F.date_trunc("minute", "ts")
    return (
        _events(spark, sf_dir)
        .filter((F.col("event_type") != "purchase") & (F.col("value") > 0))
        .select(
            F.concat(F.lit("bar-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("bar_id"),
            _event_ticker().alias("ticker"),
            start.alias("bar_at"),
            F.to_date("ts").alias("session_date"),
            F.lit("INTRADAY").alias("bar_type"),
            F.col("value").alias("close"),
            F.lit("feed").alias("source"),
            (start + F.expr("interval 1 minute")).alias("collected_at"),
            F.col("ts").alias("seen_at"),
            F.col("event_id").alias("seq"),
        )
    )


def fx_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation of each ticker-minute as a final minute bar."""
    newest = F.struct("seen_at", "seq")
    kept = ("bar_id", "session_date", "bar_type", "close", "source", "collected_at")
    return (
        fx_raw_minutes(spark, sf_dir)
        .groupBy("ticker", "bar_at")
        .agg(F.max_by(F.struct(*kept), newest).alias("_b"))
        .select("ticker", "bar_at", "_b.*")
    )


def fx_daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value before the session close; SPY covers all tickers but skips some days."""
    sessions = fx_sessions(spark, sf_dir).select("session_date", "close_ts")
    events = (
        _events(spark, sf_dir)
        .filter(F.col("value") > 0)
        .withColumn("session_date", F.to_date("ts"))
        .join(F.broadcast(sessions), "session_date")
        .filter(F.col("ts") <= F.col("close_ts"))
    )
    both = events.withColumn("ticker", F.explode(F.array(_event_ticker(), F.lit("SPY"))))
    return (
        both.groupBy("ticker", "session_date", "close_ts")
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
        .filter((F.col("ticker") != "SPY") | (F.dayofmonth("session_date") % 7 != 0))
        .select(
            F.concat_ws("-", F.lit("day"), "ticker", "session_date").alias("bar_id"),
            "ticker",
            F.col("close_ts").alias("bar_at"),
            "session_date",
            F.lit("DAILY_CLOSE").alias("bar_type"),
            "close",
            F.lit("feed").alias("source"),
            (F.col("close_ts") + F.expr("interval 5 minutes")).alias("collected_at"),
        )
    )


BAR_COLUMNS = (
    "bar_id", "ticker", "bar_at", "session_date", "bar_type", "close", "source", "collected_at",
)


def fx_bar_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes within the session and daily closes, as one ledger."""
    sessions = fx_sessions(spark, sf_dir).select("session_date", "close_ts")
    minutes = (
        fx_minutes(spark, sf_dir)
        .join(F.broadcast(sessions), "session_date")
        .filter(F.col("collected_at") <= F.col("close_ts"))
        .select(*BAR_COLUMNS)
    )
    return minutes.unionByName(fx_daily_closes(spark, sf_dir).select(*BAR_COLUMNS))


def fx_decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purchase: created two minutes before; delivered unless the id is a multiple of 11."""
    base = _events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    action = F.element_at(
        F.array(*[F.lit(a) for a in ("HOLD", "WATCH", "TRIM", "ADD", "SELL_REVIEW")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    holding = F.struct(
        _event_ticker().alias("ticker"),
        action.alias("action"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0.5)).alias("recommended_exposure"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 50 + 5).cast("double")).alias("shares"),
    )
    other = F.struct(
        F.when(F.col("user_id") % 2 == 0, "T1").otherwise("T0").alias("ticker"),
        F.lit("HOLD").alias("action"),
        F.lit(None).cast("double").alias("recommended_exposure"),
        F.lit(10.0).alias("shares"),
    )
    holdings = F.when(F.col("event_id") % 2 == 0, F.array(holding, other)).otherwise(F.array(holding))
    name = F.concat(F.lit("D"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    common = [name.alias("decision_id"), _event_account().alias("account_ref")]
    created = base.select(
        *common,
        F.lit("DECISION_CREATED").alias("event_type"),
        (F.col("ts") - F.expr("interval 2 minutes")).alias("occurred_at"),
        holdings.alias("holdings"),
        F.when(F.col("event_id") % 4 != 0, "REGULAR").alias("market_phase"),
        (F.col("event_id") * 4).alias("seq"),
    )
    sent = base.filter(F.col("event_id") % 11 != 0).select(
        *common,
        F.lit("EMAIL_SENT").alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.lit(None).cast(created.schema["holdings"].dataType).alias("holdings"),
        F.lit(None).cast("string").alias("market_phase"),
        (F.col("event_id") * 4 + 1).alias("seq"),
    )
    return created.unionByName(sent)


def fx_event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills at event times: signups buy, errors sell; some lack fees or an exact time."""
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type").isin("signup", "error") & (F.col("value") > 0))
        .select(
            _event_account().alias("account_ref"),
            _event_ticker().alias("ticker"),
            F.when(F.col("event_type") == "signup", "BUY").otherwise("SELL").alias("side"),
            (F.col("event_id") % 5 + 1).cast("double").alias("quantity"),
            F.col("value").alias("price"),
            F.when(F.col("event_id") % 97 != 0, F.lit(0.25)).alias("fees"),
            F.col("ts").alias("trade_time"),
            F.when(F.col("event_id") % 89 == 0, "NOTIFICATION_TIME_PROXY")
            .otherwise("BROKER_EXECUTION_TIME")
            .alias("trade_time_source"),
            F.col("event_id").alias("seq"),
            # One fill in thirteen is parsed two days after its message came.
            (F.col("ts") + F.expr("interval 20 seconds")).alias("received_at"),
            (
                F.col("ts") + F.when(F.col("event_id") % 13 == 0, F.expr("interval 2 days")).otherwise(F.expr("interval 30 seconds"))
            ).alias("parsed_at"),
        )
    )


def fx_statelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate log: one ticker per user; every tenth event id is a review."""
    pairs = [F.lit(x) for pair in EVENT_STATES.items() for x in pair]
    state = F.element_at(F.create_map(*pairs), F.col("event_type"))
    events = _events(spark, sf_dir).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.unix_micros("ts").alias("pos"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("occurred_at"),
        state.alias("mapped"),
    )
    order = Order(("ticker",), "pos", "seq", width=86_400_000_000)
    log = drop_chunks(
        running(with_chunks(events, order), order, {"_before": ("last", F.col("mapped"), False)})
    )
    review = (F.col("seq") % 10 == 0) & F.col("_before").isNotNull()
    return log.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("seq").cast("string"), 9, "0")).alias("event_id"),
        "ticker",
        F.when(F.col("_before").isNull(), "CANDIDATE_ADDED")
        .when(review, "CANDIDATE_REVIEWED")
        .otherwise("STATE_CHANGED")
        .alias("event_type"),
        "occurred_at",
        F.when(~review, F.col("_before")).alias("previous_state"),
        F.when(~review, F.col("mapped")).alias("new_state"),
        "pos",
        "seq",
    )


def fx_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message index rows: one message per conversation, its turns in ledger order."""
    status = (
        F.when(F.col("role") == "system", "QUARANTINED")
        .when(F.col("role") == "user", "DISCOVERED")
        .otherwise("COMMITTED")
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("source_message_id"),
        F.col("turn").alias("seq"),
        status.alias("processing_status"),
        F.lower(F.sha2("text", 256)).alias("content_hash"),
        (F.length("text") % 3).cast("int").alias("normalized_event_count"),
        "text",
    )


def fx_universe_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate list by supplier: untidy tickers, every tenth row repeats its predecessor."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    named = key - F.floor((key % 10) / 9)
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("seq"),
            F.concat(F.when(key % 2 == 0, " s").otherwise("S"), named.cast("string")).alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("n_name").alias("theme"),
        )
    )


def fx_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of fifty accounts by supplier; every 17th ticker has no prices."""
    key = F.col("l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % 50).alias("_a"), "l_suppkey")
        .agg(
            F.sum("l_quantity").alias("shares"),
            _quote(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_cost"),
        )
        .select(
            F.concat(F.lit("A"), F.col("_a").cast("string")).alias("account_ref"),
            F.concat(F.when(key % 17 == 0, "X").otherwise("S"), key.cast("string")).alias("ticker"),
            "shares",
            "avg_cost",
            F.lit(800.0).alias("last_price"),
            F.lit(None).cast("double").alias("market_value"),
            F.lit(None).cast("double").alias("portfolio_weight_pct"),
            F.when(key % 3 == 0, F.lit(-3.0)).alias("stop_loss_pct"),
            F.when(key % 4 == 0, F.lit(2.0)).alias("trim_profit_pct"),
        )
    )


def fx_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value of one-ticker accounts; every fifth changes its share count by year."""
    number = F.substring("ticker", 2, 20).cast("int")
    odd = F.year("session_date") % 2
    shares = F.lit(10.0) + F.when(number % 5 == 0, odd).otherwise(0)
    return fx_bars(spark, sf_dir).select(
        F.concat(F.lit("P"), F.col("ticker")).alias("account_ref"),
        F.col("session_date").cast("string").alias("snapshot_date"),
        "ticker",
        shares.alias("shares"),
        (F.col("close") * shares).alias("market_value"),
    )


def fx_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker-event rows with every kind of defect, one per event."""
    i = F.col("event_id")

    def pick(n: int, *values: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))

    reward = i % 7 == 0
    proxy = i % 6 == 0
    ts_micros = F.unix_micros("ts")
    shift = F.when(proxy, (i % 4) * 500_000).otherwise(-(i % 9) * 60_000_000)
    received = F.timestamp_micros(ts_micros + shift)
    return _events(spark, sf_dir).select(
        i.alias("seq"),
        F.when(i % 19 == 0, "other@example.com").otherwise(" Investor@Example.com").alias("source_account"),
        F.when(i % 17 == 0, "Spam <ads@other.example>").otherwise("Broker <Trades@Verified.example>").alias("sender"),
        F.when(i % 23 == 0, "Weekly news").otherwise(pick(3, "Trade FILLED 7", "Stock reward credited", "trade filled")).alias("subject"),
        pick(5, "true", "1", "Yes", "no", "FALSE").alias("affects_position"),
        F.when(i % 13 == 0, "PROBABLE").otherwise("confirmed").alias("parse_confidence"),
        F.when(reward, "STOCK_REWARD").otherwise("trade").alias("event_type"),
        F.when(reward & (i % 14 == 0), "CREDITED")
        .when(reward, "FILLED")
        .when(i % 11 == 0, "CANCELLED")
        .when(i % 2 == 0, "FILLED")
        .otherwise("PARTIALLY_FILLED")
        .alias("status"),
        _event_account().alias("account_ref"),
        F.concat(F.lit(" "), F.lower(_event_ticker())).alias("ticker"),
        F.col("ts").alias("trade_time"),
        F.when(proxy, "NOTIFICATION_TIME_PROXY").otherwise("BROKER_EXECUTION_TIME").alias("trade_time_source"),
        received.alias("message_received_at"),
        (received + F.expr("interval 30 seconds")).alias("parsed_at"),
    )


def fx_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overlay per account, each later than the one of the account before."""
    n = F.substring("account_ref", 2, 4).cast("int")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return (
        fx_broker(spark, sf_dir).select("account_ref").distinct().select(
            "account_ref",
            F.concat(F.lit("corr-"), "account_ref").alias("correction_id"),
            F.timestamp_micros((start + n.cast("long") * 43_200_000_000)).alias("corrected_at"),
            (n % 10 != 9).alias("active"),
        )
    )


def fx_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections in arrival order; each names the last good one, every ninth a wrong one, every seventh is too early."""
    seq = F.col("event_id")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    events = _events(spark, sf_dir).filter(F.col("event_type") == "view").select(
        _event_account().alias("account_ref"),
        seq.alias("seq"),
        F.concat(F.lit("corr-"), F.lpad(seq.cast("string"), 9, "0")).alias("correction_id"),
        F.col("value").cast("string").alias("content"),
        F.timestamp_micros(start + seq * 1_000_000 - F.when(seq % 7 == 0, 777_600_000_000).otherwise(0)).alias("corrected_at"),
    )
    order = Order(("account_ref",), "seq", "seq", width=1 << 16)
    good = F.when((F.col("seq") % 9 != 0) & (F.col("seq") % 7 != 0), F.col("correction_id"))
    linked = drop_chunks(running(with_chunks(events, order), order, {"_before": ("last", good, False)}))
    wrong = (F.col("seq") % 9 == 0) | ((F.col("seq") % 7 == 0) & F.col("_before").isNull())
    return linked.select(
        "account_ref", "seq", "correction_id", "content", "corrected_at",
        F.when(wrong, "corr-000000").otherwise(F.col("_before")).alias("expected_previous"),
        (F.col("seq") % 2 == 0).alias("active"),
    )


def fx_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, intent and sent events per purchase, with planted faults by id."""
    base = _events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    i = F.col("event_id")
    marker = F.concat(F.lit("mk-"), i.cast("string"))
    steps = F.filter(
        F.array(
            F.struct(F.lit(0).alias("k"), F.lit("DECISION_CREATED").alias("event_type"), F.lit(-120).alias("s")),
            F.when(i % 13 != 0, F.struct(F.lit(1).alias("k"), F.lit("EMAIL_SEND_INTENT").alias("event_type"), F.lit(-60).alias("s"))),
            F.struct(F.lit(2).alias("k"), F.lit("EMAIL_SENT").alias("event_type"), F.when(i % 19 == 0, -90).otherwise(0).alias("s")),
            F.when(i % 23 == 0, F.struct(F.lit(3).alias("k"), F.lit("EMAIL_FAILED").alias("event_type"), F.lit(5).alias("s"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = base.select(
        F.concat(F.lit("D"), F.lpad(i.cast("string"), 9, "0")).alias("decision_id"),
        i.alias("_i"), "ts", marker.alias("_m"), F.explode(steps).alias("_s"),
    )
    k, mail = F.col("_s.k"), F.col("_s.k") > 0
    at = F.timestamp_micros(F.unix_micros("ts") + F.col("_s.s").cast("long") * 1_000_000)
    return rows.select(
        "decision_id",
        F.concat_ws("-", F.lit("evt"), "decision_id", k.cast("string")).alias("event_id"),
        F.col("_s.event_type").alias("event_type"),
        at.alias("occurred_at"),
        F.when(mail & (k == 2) & (F.col("_i") % 17 == 0), "mk-other").when(mail, F.col("_m")).alias("marker"),
        F.when(k == 1, "a@example.com").alias("recipient"),
        F.when((k == 1) & (F.col("_i") % 29 != 0), "brief").alias("subject"),
        F.when((k == 2) & (F.col("_i") % 31 != 0), "mid").alias("message_id"),
        F.when(k == 3, "bounce").alias("error"),
        k.cast("long").alias("pos"),
        (F.col("_i") * 4 + k).alias("seq"),
    )


def fx_sent_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw minutes as ledger rows; some sent twice, some twice with another close."""
    raw = fx_raw_minutes(spark, sf_dir).drop("seen_at").withColumn("seq", F.col("seq") * 2)
    i = F.col("seq") / 2
    again = raw.filter(i % 20 == 0)
    changed = raw.filter(i % 33 == 0).withColumn("close", F.col("close") + 1.0)
    return raw.unionByName(again.withColumn("seq", F.col("seq") + 1)).unionByName(
        changed.withColumn("seq", F.col("seq") + 1_000_000_000)
    )


def fx_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan batches of at most ten messages each, one message per conversation."""
    c = F.col("conv_id")
    firsts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("text", "turn").alias("text")
    )
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def at(minutes: Column) -> Column:
        return F.timestamp_micros((start + minutes.cast("long") * 60_000_000))

    status = F.when(c % 5 == 0, "QUARANTINED").when(c % 3 == 0, "IGNORED").otherwise("COMMITTED")
    event = F.struct(
        F.concat_ws("-", F.lit("ex"), c.cast("string")).alias("execution_id"),
        F.lit("TEST").alias("ticker"),
        F.when(c % 2 == 0, "true").otherwise("no").alias("affects_position"),
        F.lit("10").alias("quantity"),
        at(c + F.when(c % 8 == 0, 100).otherwise(0)).alias("trade_time"),
    )
    events = F.when(status == "COMMITTED", F.array_repeat(event, (F.col("turns") % 3).cast("int"))).otherwise(
        F.array_repeat(event, 0)
    )
    resolution = F.when(c % 10 == 0, "RESOLVED").otherwise("OPEN")
    message = F.struct(
        F.concat(F.lit("m"), c.cast("string")).alias("source_message_id"),
        F.concat(F.lit("t"), c.cast("string")).alias("source_thread_id"),
        at(c).alias("message_received_at"),
        F.lit("Broker <trades@verified.example>").alias("sender"),
        F.when(c % 41 != 0, "Trade filled").alias("subject"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit("1.0.0").alias("parser_version"),
        F.lit("fill").alias("lifecycle_type"),
        status.alias("processing_status"),
        F.lit(None).cast("timestamp").alias("discovered_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        events.alias("events"),
        F.when(c % 5 == 0, F.struct(F.lit("unclear").alias("reason"), resolution.alias("resolution_status"))).alias("quarantine"),
        F.lit(None).cast("string").alias("notes"),
    )
    b = F.col("_b")
    grouped = firsts.withColumn("_b", F.floor(c / 10)).groupBy("_b").agg(
        F.array_sort(F.collect_list(message)).alias("messages")
    )
    number = F.lpad(b.cast("string"), 6, "0")
    return grouped.select(
        F.when(b % 37 == 0, 2).otherwise(1).alias("schema_version"),
        F.concat(F.lit("run-"), number).alias("run_id"),
        F.concat(F.lit("batch-"), number).alias("batch_id"),
        F.lit("Investor@Example.com").alias("target_account"),
        F.concat(F.lit("txn-"), F.lpad((b - 1).cast("string"), 6, "0")).alias("expected_parent_transaction_id"),
        F.struct(
            at(b * 10 + 8).alias("started_at"),
            at(b * 10 + 12).alias("completed_at"),
            at(b * 10 - 1440).alias("window_start"),
            (b % 7 != 0).alias("pagination_complete"),
            F.when(b % 11 == 0, 0).otherwise(1).cast("int").alias("pages_fetched"),
            F.when(b % 4 == 0, "next").otherwise("").alias("terminal_next_page_token"),
            (b * 100).cast("string").alias("history_id_before"),
            (b * 100 + F.when(b % 6 == 0, -50).otherwise(100)).cast("string").alias("history_id_after"),
        ).alias("scan"),
        "messages",
        F.concat(F.lit("txn-"), number).alias("transaction_id"),
        (b + 1).alias("scan_no"),
    )


def fx_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan a batch, each on the cursor of the last good one, with planted backward, wrong and stale ones."""
    b = F.col("scan_no") - 1
    backwards, wrong, stale = (b % 6 == 5), (b % 10 == 3), (b % 13 == 8)
    good = ~(backwards | wrong | stale)
    rows = fx_batches(spark, sf_dir).select(
        "batch_id", "target_account", "scan_no", "transaction_id", (b % 7 == 2).alias("blocked"), F.col("scan.completed_at").alias("completed_at"),
        F.when(good, F.col("transaction_id")).alias("_good"),
        F.when(good & (b % 7 != 2), (b + 1) * 100).alias("_mark"),
    )
    order = Order(("target_account",), "scan_no", "scan_no", width=1 << 16)
    last = {"_parent": ("last", F.col("_good"), False), "_line": ("last", F.col("_mark"), False)}
    linked = drop_chunks(running(with_chunks(rows, order), order, last))
    line = F.coalesce("_line", F.lit(0))
    return linked.select(
        "batch_id", "target_account", "scan_no", "transaction_id", "blocked", "completed_at",
        F.when(stale, "txn-unknown").otherwise(F.col("_parent")).alias("expected_parent"),
        F.when(wrong, line + 1).otherwise(line).cast("string").alias("history_id_before"),
        F.when(backwards, line - 50).otherwise((b + 1) * 100).cast("string").alias("history_id_after"),
    )
