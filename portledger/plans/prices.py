"""Plans over daily bars: returns, averages, drawdowns, tail risk, indicators."""

from __future__ import annotations


from pyspark.sql import Window, functions as F

from portledger.functions import indicators
from portledger.operators import metrics as m
from portledger.plans.fixtures import fx_bars, fx_market
from portledger.plans.registry import plan, rounded

METRICS_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in m.METRIC_COLUMNS)


def _metric_sql(*columns: str) -> str:
    return f"SELECT ticker, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM metrics"


@plan(
    "j1_quote_metrics",
    f"SELECT ticker, {METRICS_SQL}, price_as_of, observation_count, '' AS data_note FROM metrics",
    uses=("metrics",),
)
def quote_metrics(spark, sf_dir):
    return rounded(m.quote_metrics(fx_bars(spark, sf_dir), fx_market(spark, sf_dir)))


@plan(
    "c1_completed_bars",
    """SELECT ticker, count(*) AS bars, CAST(max(session_date) AS VARCHAR) AS last_session
       FROM fx_bars WHERE session_date < DATE '2000-06-15' GROUP BY 1""",
    uses=("fx_bars",),
)
def completed(spark, sf_dir):
    noon = F.lit("2000-06-15 16:00:00").cast("timestamp")
    kept = m.completed_bars(fx_bars(spark, sf_dir), noon)
    return kept.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"), F.max("session_date").cast("string").alias("last_session")
    )


@plan(
    "f1_daily_return",
    """SELECT ticker, CAST(session_date AS VARCHAR) AS session_date, CASE WHEN round(ret, 6) = 0 THEN 0 ELSE round(ret, 6) END AS ret FROM fx_bars_rows""",
    uses=("fx_bars_rows",),
)
def daily_return(spark, sf_dir):
    out = m.daily_returns(fx_bars(spark, sf_dir))
    return rounded(out.select("ticker", F.col("session_date").cast("string"), "ret"))


def _grouped(spark, sf_dir, **aggs):
    rows = m.numbered(fx_bars(spark, sf_dir))
    return rounded(rows.groupBy("ticker").agg(*[a.alias(n) for n, a in aggs.items()]))


RETURN_COLUMNS = ("ret_1d_pct", "ret_5d_pct", "ret_20d_pct", "ret_60d_pct")


@plan(
    "f2_total_return",
    """SELECT ticker, """
    + ", ".join(
        f"round((max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k={d} THEN close END)-1)*100, 6) AS ret_{d}d_pct"
        for d in (1, 5, 20, 60)
    )
    + " FROM fx_bars_rows GROUP BY ticker",
    uses=("fx_bars_rows",),
)
def total_return(spark, sf_dir):
    return _grouped(spark, sf_dir, **{f"ret_{d}d_pct": m.total_return(d) for d in (1, 5, 20, 60)})


@plan(
    "f3_sma_gap",
    """SELECT ticker, """
    + ", ".join(
        f"""round(max(CASE WHEN k=0 THEN CASE WHEN n>={d} THEN (close/s{d}-1)*100 END END), 6) AS sma_{d}_gap_pct"""
        for d in (20, 50, 200)
    )
    + """ FROM (SELECT *, """
    + ", ".join(
        f"avg(close) OVER (PARTITION BY ticker ORDER BY session_date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW) AS s{d}"
        for d in (20, 50, 200)
    )
    + " FROM fx_bars_rows) GROUP BY ticker",
    uses=("fx_bars_rows",),
)
def sma_gap(spark, sf_dir):
    return _grouped(spark, sf_dir, **{f"sma_{d}_gap_pct": m.sma_gap(d) for d in (20, 50, 200)})


@plan(
    "f4_max_drawdown",
    """SELECT ticker, round(min(CASE WHEN k<252 THEN close/p252-1 END)*100, 6) AS max_drawdown_1y_pct,
              round(min(CASE WHEN k<60 THEN close/p60-1 END)*100, 6) AS max_drawdown_60d_pct
       FROM (SELECT *, max(CASE WHEN k<60 THEN close END) OVER (PARTITION BY ticker ORDER BY session_date) AS p60,
                    max(CASE WHEN k<252 THEN close END) OVER (PARTITION BY ticker ORDER BY session_date) AS p252
             FROM fx_bars_rows) GROUP BY ticker""",
    uses=("fx_bars_rows",),
)
def max_drawdown(spark, sf_dir):
    found = m.quote_metrics(fx_bars(spark, sf_dir), fx_market(spark, sf_dir))
    return rounded(found.select("ticker", "max_drawdown_1y_pct", "max_drawdown_60d_pct"))


@plan(
    "f5_current_drawdown",
    """SELECT ticker, round((arg_max(close, session_date)/max(close)-1)*100, 6) AS current_drawdown_1y_pct
       FROM fx_bars_rows WHERE k < 252 GROUP BY ticker""",
    uses=("fx_bars_rows",),
)
def current_drawdown(spark, sf_dir):
    found = m.quote_metrics(fx_bars(spark, sf_dir), fx_market(spark, sf_dir))
    return rounded(found.select("ticker", "current_drawdown_1y_pct"))


@plan(
    "f6_volume_ratio",
    """SELECT ticker, round(CASE WHEN max(n)>=21 THEN max(CASE WHEN k=0 THEN volume END)
              / avg(CASE WHEN k BETWEEN 1 AND 20 THEN volume END) END, 6) AS volume_ratio_20d
       FROM fx_bars_rows GROUP BY ticker""",
    uses=("fx_bars_rows",),
)
def volume_ratio(spark, sf_dir):
    k, volume = F.col("k"), F.col("volume")
    prior = F.avg(F.when(k.between(1, 20), volume))
    ratio = F.when(
        (F.max("n") >= 21) & (prior != 0), F.max(F.when(k == 0, volume)) / prior
    )
    return _grouped(spark, sf_dir, volume_ratio_20d=ratio)


@plan(
    "f7_rsi_14",
    "SELECT ticker, round(rsi, 6) AS rsi_14 FROM fx_bars_ind",
    uses=("fx_bars_ind",),
)
def rsi(spark, sf_dir):
    change = F.col("close") - F.col("prev")
    return _grouped(spark, sf_dir, rsi_14=indicators.rsi_last(change, F.col("j"), F.col("n")))


@plan(
    "f8_macd_hist",
    "SELECT ticker, round(hist, 6) AS macd_hist FROM fx_bars_ind",
    uses=("fx_bars_ind",),
)
def macd(spark, sf_dir):
    hist = indicators.macd_hist_last(F.col("close"), F.col("j"), F.col("n"))
    return _grouped(spark, sf_dir, macd_hist=hist)


@plan(
    "f9_atr_14_pct",
    """SELECT i.ticker, round(max(i.atr) / max(CASE WHEN k=0 THEN close END) * 100, 6) AS atr_14_pct
       FROM fx_bars_ind i JOIN fx_bars_rows r ON i.ticker = r.ticker GROUP BY 1""",
    uses=("fx_bars_ind",),
)
def atr(spark, sf_dir):
    prev, high, low = F.col("prev"), F.col("high"), F.col("low")
    span = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    last = F.max(F.when(F.col("k") == 0, F.col("close")))
    return _grouped(
        spark, sf_dir, atr_14_pct=indicators.atr_last(span, F.col("j"), F.col("n")) / last * 100.0
    )


@plan(
    "i2_ema_last",
    """SELECT ticker, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26 FROM fx_bars_fold WHERE j = n""",
    uses=("fx_bars_fold",),
)
def ema_last(spark, sf_dir):
    j, n, close = F.col("j"), F.col("n"), F.col("close")
    return _grouped(
        spark,
        sf_dir,
        ema_12=indicators.ema_last(close, j, n, 2.0 / 13),
        ema_26=indicators.ema_last(close, j, n, 2.0 / 27),
    )


@plan(
    "i3_ema_series",
    """SELECT ticker, CAST(session_date AS VARCHAR) AS session_date, round(e12, 6) AS ema
       FROM (SELECT f.ticker, b.session_date, f.e12 FROM fx_bars_fold f
             JOIN fx_bars_rows b ON f.ticker = b.ticker AND f.j = b.j)""",
    uses=("fx_bars_fold",),
)
def ema_series(spark, sf_dir):
    series = m.ema_series(fx_bars(spark, sf_dir), 2.0 / 13)
    return rounded(series.select("ticker", F.col("session_date").cast("string"), "ema"))


@plan(
    "i3_rsi_macd_atr",
    """SELECT i.ticker, round(max(rsi), 6) AS rsi_14, round(max(hist), 6) AS macd_hist, round(max(i.atr), 6) AS atr_14
       FROM fx_bars_ind i GROUP BY 1""",
    uses=("fx_bars_ind",),
)
def rsi_macd_atr(spark, sf_dir):
    j, n, close, prev = F.col("j"), F.col("n"), F.col("close"), F.col("prev")
    high, low = F.col("high"), F.col("low")
    span = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    return _grouped(
        spark,
        sf_dir,
        rsi_14=indicators.rsi_last(close - prev, j, n),
        macd_hist=indicators.macd_hist_last(close, j, n),
        atr_14=indicators.atr_last(span, j, n),
    )


@plan(
    "e5_beta",
    """SELECT ticker, count(*) AS pairs,
              round(CASE WHEN count(*) >= 40 THEN covar_samp(ret, bench_ret) / var_samp(bench_ret) END, 6) AS beta_spy
       FROM (SELECT b.ticker, b.ret, x.ret AS bench_ret FROM fx_bars_rows b
             JOIN bench_rows x ON b.session_date = x.session_date WHERE b.ret IS NOT NULL AND x.ret IS NOT NULL)
       GROUP BY ticker""",
    uses=("fx_bars_rows", "bench_rows"),
)
def beta(spark, sf_dir):
    pairs = _paired(spark, sf_dir)
    slope = F.covar_samp("ret", "bench_ret") / F.var_samp("bench_ret")
    return rounded(
        pairs.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("pairs"),
            F.when((F.count(F.lit(1)) >= 40) & (F.var_samp("bench_ret") != 0), slope).alias("beta_spy"),
        )
    )


def _paired(spark, sf_dir):
    bench = m.benchmark_returns(fx_market(spark, sf_dir)).select("session_date", "bench_ret")
    own = m.daily_returns(fx_bars(spark, sf_dir))
    # One benchmark row per session: bounded by the calendar, so broadcast.
    return own.join(F.broadcast(bench), "session_date").filter(
        F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    )


@plan(
    "d1_benchmark_return_join",
    """SELECT b.ticker, CAST(b.session_date AS VARCHAR) AS session_date, CASE WHEN round(b.ret, 6) = 0 THEN 0 ELSE round(b.ret, 6) END AS ret,
              CASE WHEN round(x.ret, 6) = 0 THEN 0 ELSE round(x.ret, 6) END AS bench_ret
       FROM fx_bars_rows b JOIN bench_rows x ON b.session_date = x.session_date
       WHERE b.ret IS NOT NULL AND x.ret IS NOT NULL""",
    uses=("fx_bars_rows", "bench_rows"),
)
def benchmark_return_join(spark, sf_dir):
    return rounded(
        _paired(spark, sf_dir).select(
            "ticker", F.col("session_date").cast("string"), "ret", "bench_ret"
        )
    )


@plan(
    "d2_benchmark_relative",
    """SELECT ticker, round(own - (SELECT (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=20 THEN close END)-1)*100
                                   FROM bench_rows), 6) AS rel_spy_20d_pct
       FROM (SELECT ticker, (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=20 THEN close END)-1)*100 AS own
             FROM fx_bars_rows GROUP BY ticker)""",
    uses=("fx_bars_rows", "bench_rows"),
)
def benchmark_relative(spark, sf_dir):
    """The benchmark value is one number: a scalar subquery instead of a cross join."""
    own = m.numbered(fx_bars(spark, sf_dir)).groupBy("ticker").agg(m.total_return(20).alias("own"))
    spy = m.numbered(fx_market(spark, sf_dir)).agg(m.total_return(20).alias("r")).scalar()
    return rounded(own.select("ticker", (F.col("own") - spy).alias("rel_spy_20d_pct")))


@plan(
    "e6_annualised_vol",
    """SELECT ticker, round(CASE WHEN count(ret) >= 10 THEN stddev_samp(ret) * sqrt(252) * 100 END, 6) AS vol_30d_ann_pct
       FROM fx_bars_rows WHERE k < 30 GROUP BY ticker""",
    uses=("fx_bars_rows",),
)
def annualised_vol(spark, sf_dir):
    return _grouped(spark, sf_dir, vol_30d_ann_pct=m.annualised_vol(30))


@plan(
    "e7_var_cvar_worst",
    _metric_sql("var_95_1d_pct", "cvar_95_1d_pct", "worst_1d_pct"),
    uses=("metrics",),
)
def tail_risk(spark, sf_dir):
    out = m.quote_metrics(fx_bars(spark, sf_dir), fx_market(spark, sf_dir))
    return rounded(out.select("ticker", "var_95_1d_pct", "cvar_95_1d_pct", "worst_1d_pct"))


@plan(
    "e7_quantile_fallback",
    """SELECT ticker, max(c) AS n, round(max(cut) * 100, 6) AS var_95_1d_pct,
              round(avg(CASE WHEN ret <= cut THEN ret END) * 100, 6) AS cvar_95_1d_pct
       FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY ticker) AS cut,
                    count(*) OVER (PARTITION BY ticker) AS c
             FROM fx_bars_rows WHERE k < 252 AND ret IS NOT NULL)
       GROUP BY ticker HAVING max(c) >= 20""",
    uses=("fx_bars_rows",),
)
def quantile_fallback(spark, sf_dir):
    return rounded(m.value_at_risk_quantile(fx_bars(spark, sf_dir)))


