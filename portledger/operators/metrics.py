"""Price and risk metrics per ticker from a long table of daily bars.

Input: ``bars(ticker, session_date, high, low, close, volume)`` with at most one
row per ticker and session. A ticker therefore holds one row per session, a few
hundred a year however large the table grows, and one window per ticker is
bounded by the calendar. All metrics share one shuffle by ticker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.functions import indicators
from portledger.functions.columns import NEW_YORK, minute_of_day, session_date

YEAR = 252
# Fixed value: the 5 % quantile of the standard normal distribution.
NORMAL_05 = -1.6448536269514722
BAR_READY_MINUTE = 16 * 60 + 15

METRIC_COLUMNS = (
    "close", "ret_1d_pct", "ret_5d_pct", "ret_20d_pct", "ret_60d_pct", "vol_30d_ann_pct",
    "max_drawdown_1y_pct", "current_drawdown_1y_pct", "max_drawdown_60d_pct",
    "sma_20_gap_pct", "sma_50_gap_pct", "sma_200_gap_pct", "rsi_14", "macd_hist", "atr_14_pct",
    "volume_ratio_20d", "beta_spy", "rel_spy_20d_pct", "rel_spy_60d_pct",
    "var_95_1d_pct", "cvar_95_1d_pct", "worst_1d_pct",
)


def completed_bars(bars: DataFrame, now: Column, zone: str = NEW_YORK) -> DataFrame:
    """Drop the session still in progress; from 16:15 local time on keep everything."""
    ready = minute_of_day(now, zone) >= BAR_READY_MINUTE
    return bars.filter(ready | (F.col("session_date") < session_date(now, zone)))


def ohlcv_wide_to_long(wide: DataFrame, *, field_first: bool, sep: str = "|") -> DataFrame:
    """Wide two-level price columns (``ticker|field`` or ``field|ticker``) to one row per ticker.

    One projection and one explode per input row: the tickers are columns, so no
    shuffle is needed to bring the fields of a ticker together.
    """
    fields = ("open", "high", "low", "close", "volume")
    found: dict[str, dict[str, str]] = {}
    for name in wide.columns:
        if sep not in name:
            continue
        left, right = name.split(sep, 1)
        field, ticker = (left, right) if field_first else (right, left)
        if field.lower() in fields:
            found.setdefault(ticker.upper(), {})[field.lower()] = name
    rows = [
        F.struct(
            F.lit(ticker).alias("ticker"),
            *[
                (F.col(f"`{cols[f]}`") if f in cols else F.lit(None)).cast("double").alias(f)
                for f in fields
            ],
        )
        for ticker, cols in sorted(found.items())
    ]
    long = wide.select("session_date", F.explode(F.array(*rows)).alias("_r"))
    return long.select("session_date", "_r.*").dropna("all", subset=list(fields))


def numbered(bars: DataFrame) -> DataFrame:
    """Closes in order with ``j`` (row number), ``n`` (rows), ``k`` (age, 0 = last) and returns."""
    w = Window.partitionBy("ticker").orderBy("session_date")
    whole = Window.partitionBy("ticker")
    prev = F.lag("close").over(w)
    return (
        bars.filter(F.col("close").isNotNull() & ~F.isnan("close"))
        .withColumn("j", F.row_number().over(w))
        .withColumn("prev", prev)
        .withColumn("peak", F.max("close").over(w))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("k", F.col("n") - F.col("j"))
        .withColumn("ret", F.col("close") / F.col("prev") - 1.0)
    )


def daily_returns(bars: DataFrame) -> DataFrame:
    return numbered(bars).select("ticker", "session_date", "close", "ret")


def _tail(value: Column, length: int) -> Column:
    return F.when(F.col("k") < length, value)


def _at(age: int) -> Column:
    return F.max(F.when(F.col("k") == age, F.col("close")))


def total_return(age: int) -> Column:
    return (_at(0) / _at(age) - 1.0) * 100.0


def sma_gap(days: int) -> Column:
    mean = F.avg(_tail(F.col("close"), days))
    return F.when((F.max("n") >= days) & (mean != 0), (_at(0) / mean - 1.0) * 100.0)


def annualised_vol(days: int) -> Column:
    sample = _tail(F.col("ret"), days)
    return F.when(
        F.count(sample) >= max(5, days // 3), F.stddev_samp(sample) * math.sqrt(YEAR) * 100.0
    )


def benchmark_returns(benchmark_bars: DataFrame) -> DataFrame:
    """Returns of one benchmark ticker: one row per session, so broadcastable."""
    return numbered(benchmark_bars).select(
        "session_date", F.col("ret").alias("bench_ret"), F.col("k").alias("bench_k"),
        F.col("close").alias("bench_close"),
    )


def quote_metrics(bars: DataFrame, benchmark_bars: DataFrame) -> DataFrame:
    """All metrics of every ticker in one pass.

    ``benchmark_bars`` must hold a single ticker: its rows are one per session,
    which bounds the broadcast.
    """
    bench = F.broadcast(benchmark_returns(benchmark_bars).select("session_date", "bench_ret"))
    w = Window.partitionBy("ticker").orderBy("session_date")
    whole = Window.partitionBy("ticker")
    rows = numbered(bars)
    year_ret = F.when((F.col("k") < YEAR) & F.col("ret").isNotNull(), F.col("ret"))
    year_n = F.count(year_ret).over(whole)
    var = F.avg(year_ret).over(whole) + NORMAL_05 * F.stddev_samp(year_ret).over(whole)
    high, low = F.coalesce("high", "close"), F.coalesce("low", "close")
    spread = F.greatest(
        high - low, F.abs(high - F.col("prev")), F.abs(low - F.col("prev"))
    )
    rows = (
        rows.withColumn("peak60", F.max(_tail(F.col("close"), 60)).over(w))
        .withColumn("peak_year", F.max(_tail(F.col("close"), YEAR)).over(w))
        .withColumn("ret_n", year_n)
        .withColumn("var_ret", var)
        .withColumn("vol_n", F.count("volume").over(whole))
        .withColumn("vol_k", F.col("vol_n") - F.count("volume").over(w))
        .withColumn("tr", spread)
        .join(bench, "session_date", "left")
    )
    j, n = F.col("j"), F.col("n")
    paired = F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    own, other = F.when(paired, F.col("ret")), F.when(paired, F.col("bench_ret"))
    tail_ret = F.when(F.col("k") < YEAR, F.col("ret"))
    enough = F.max("ret_n") >= 20
    volume = F.when(F.col("volume").isNotNull(), F.col("volume"))
    prior = F.avg(F.when((F.col("vol_k") >= 1) & (F.col("vol_k") <= 20), volume))
    last_volume = F.max(F.when(F.col("vol_k") == 0, volume))
    last = _at(0)
    mean_below = F.avg(F.when(tail_ret < F.col("var_ret"), tail_ret))
    out = rows.groupBy("ticker").agg(
        last.alias("close"),
        *[total_return(d).alias(f"ret_{d}d_pct") for d in (1, 5, 20, 60)],
        annualised_vol(30).alias("vol_30d_ann_pct"),
        (F.min(_tail(F.col("close") / F.col("peak_year") - 1.0, YEAR)) * 100.0).alias("max_drawdown_1y_pct"),
        (F.max(F.when(F.col("k") == 0, F.col("close") / F.col("peak_year") - 1.0)) * 100.0).alias(
            "current_drawdown_1y_pct"
        ),
        (F.min(_tail(F.col("close") / F.col("peak60") - 1.0, 60)) * 100.0).alias(
            "max_drawdown_60d_pct"
        ),
        *[sma_gap(d).alias(f"sma_{d}_gap_pct") for d in (20, 50, 200)],
        indicators.rsi_last(F.col("close") - F.col("prev"), j, n).alias("rsi_14"),
        indicators.macd_hist_last(F.col("close"), j, n).alias("macd_hist"),
        (indicators.atr_last(F.col("tr"), j, n) / F.when(last != 0, last) * 100.0).alias("atr_14_pct"),
        F.when((F.max("vol_n") >= 21) & (prior != 0), last_volume / prior).alias("volume_ratio_20d"),
        F.when(
            (F.count(own) >= 40) & (F.var_samp(other) != 0),
            F.covar_samp(own, other) / F.var_samp(other),
        ).alias("beta_spy"),
        F.when(enough, F.max("var_ret") * 100.0).alias("var_95_1d_pct"),
        F.when(enough, F.coalesce(mean_below, F.max("var_ret")) * 100.0).alias("cvar_95_1d_pct"),
        F.when(enough, F.min(tail_ret) * 100.0).alias("worst_1d_pct"),
        F.max("session_date").cast("string").alias("price_as_of"),
        F.max("n").alias("observation_count"),
    )
    # The benchmark's own returns are one value each: scalar subqueries, no join.
    aged = benchmark_returns(benchmark_bars).select(
        F.col("bench_k").alias("k"), F.col("bench_close").alias("close")
    )
    spy = {d: aged.agg(total_return(d).alias("r")).scalar() for d in (20, 60)}
    return out.select(
        "ticker",
        *[c for c in out.columns if c != "ticker"],
        *[(F.col(f"ret_{d}d_pct") - spy[d]).alias(f"rel_spy_{d}d_pct") for d in (20, 60)],
        F.lit("").alias("data_note"),
    )


def complete_metrics(tickers: DataFrame, metrics: DataFrame, note: str = "missing price data") -> DataFrame:
    """Every wanted ticker; one without prices gets NULL metrics and a note."""
    joined = tickers.select("ticker").distinct().join(metrics, "ticker", "left")
    return joined.withColumn("data_note", F.coalesce("data_note", F.lit(note))).withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0))
    )


def value_at_risk_quantile(bars: DataFrame) -> DataFrame:
    """The fallback tail risk: 5 % quantile of the last year and the mean at or below it."""
    rows = numbered(bars).filter((F.col("k") < YEAR) & F.col("ret").isNotNull())
    whole = Window.partitionBy("ticker")
    cut = F.percentile("ret", F.lit(0.05)).over(whole)
    return (
        rows.withColumn("cut", cut)
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.max("cut") * 100.0).alias("var_95_1d_pct"),
            (F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret"))) * 100.0).alias("cvar_95_1d_pct"),
        )
        .filter(F.col("n") >= 20)
    )


def ema_series(bars: DataFrame, alpha: float) -> DataFrame:
    """The full exponential average per ticker, folded over one array of its sessions."""
    packed = bars.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("session_date", "close"))).alias("_b")
    )
    state = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("ys"))

    def step(acc: Column, bar: Column) -> Column:
        y = F.when(acc["y"].isNull(), bar["close"]).otherwise(
            acc["y"] * (1.0 - alpha) + bar["close"] * alpha
        )
        return F.struct(y.alias("y"), F.concat(acc["ys"], F.array(y)).alias("ys"))

    folded = packed.withColumn("_y", F.aggregate("_b", state, step)["ys"])
    zipped = F.explode(F.arrays_zip("_b", "_y")).alias("_z")
    return folded.select("ticker", zipped).select(
        "ticker", "_z._b.session_date", "_z._b.close", F.col("_z._y").alias("ema")
    )


