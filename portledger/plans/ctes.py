"""Shared views of the SQL twins, each written once and pulled in by name."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *uses: str) -> None:
    CTES[name] = (uses, sql.strip())


def with_ctes(body: str, uses: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body.strip()
    parts = [f"{name.split('(')[0]} AS (\n{CTES[name][1]}\n)" for name in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()


cte("fx_bars", """
SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS session_date,
       round(500 + 40 * ln(sum(l_extendedprice) / sum(l_quantity)) + 1e-7, 4) AS close,
       round(500 + 40 * ln(max(l_extendedprice / l_quantity)) + 1e-7, 4) AS high,
       round(500 + 40 * ln(min(l_extendedprice / l_quantity)) + 1e-7, 4) AS low,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2
""")

cte("fx_market", """
SELECT 'SPY' AS ticker, CAST(l_shipdate AS DATE) AS session_date,
       round(500 + 40 * ln(sum(l_extendedprice) / sum(l_quantity)) + 1e-7, 4) AS close,
       round(500 + 40 * ln(max(l_extendedprice / l_quantity)) + 1e-7, 4) AS high,
       round(500 + 40 * ln(min(l_extendedprice / l_quantity)) + 1e-7, 4) AS low,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2
""")

cte("bench_names", """
SELECT * FROM (VALUES ('S1','QQQ'),('S2','IWM'),('S3','SMH'),('S4','SOXX'),('S5','IGV'),
  ('S6','RSP'),('S7','HYG'),('S8','IEF'),('S9','^VIX')) AS t(supplier, name)
""")

cte("fx_benchmarks", """
SELECT * FROM fx_market
UNION ALL
SELECT name, session_date, close * f, high * f, low * f, volume
FROM (SELECT b.*, n.name, CASE WHEN n.name = '^VIX' THEN 0.02 ELSE 1.0 END AS f
      FROM fx_bars b JOIN bench_names n ON b.ticker = n.supplier)
""", "fx_bars", "fx_market", "bench_names")

cte("all_bars", """
SELECT * FROM fx_bars UNION ALL SELECT * FROM fx_benchmarks
""", "fx_bars", "fx_benchmarks")


def _metrics(bars: str) -> str:
    return f"""
SELECT m.*, ret_20d_pct - (SELECT (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=20 THEN close END)-1)*100
                           FROM bench_rows) AS rel_spy_20d_pct,
       ret_60d_pct - (SELECT (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=60 THEN close END)-1)*100
                      FROM bench_rows) AS rel_spy_60d_pct
FROM (
  SELECT r.ticker,
    max(CASE WHEN k=0 THEN close END) AS close,
    (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=1 THEN close END)-1)*100 AS ret_1d_pct,
    (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=5 THEN close END)-1)*100 AS ret_5d_pct,
    (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=20 THEN close END)-1)*100 AS ret_20d_pct,
    (max(CASE WHEN k=0 THEN close END)/max(CASE WHEN k=60 THEN close END)-1)*100 AS ret_60d_pct,
    CASE WHEN count(CASE WHEN k<30 THEN ret END)>=10
         THEN stddev_samp(CASE WHEN k<30 THEN ret END)*sqrt(252)*100 END AS vol_30d_ann_pct,
    min(CASE WHEN k<252 THEN close/peak_year-1 END)*100 AS max_drawdown_1y_pct,
    max(CASE WHEN k=0 THEN close/peak_year-1 END)*100 AS current_drawdown_1y_pct,
    min(CASE WHEN k<60 THEN close/peak60-1 END)*100 AS max_drawdown_60d_pct,
    CASE WHEN max(n)>=20 THEN (max(CASE WHEN k=0 THEN close END)/avg(CASE WHEN k<20 THEN close END)-1)*100 END AS sma_20_gap_pct,
    CASE WHEN max(n)>=50 THEN (max(CASE WHEN k=0 THEN close END)/avg(CASE WHEN k<50 THEN close END)-1)*100 END AS sma_50_gap_pct,
    CASE WHEN max(n)>=200 THEN (max(CASE WHEN k=0 THEN close END)/avg(CASE WHEN k<200 THEN close END)-1)*100 END AS sma_200_gap_pct,
    max(i.rsi) AS rsi_14, max(i.hist) AS macd_hist,
    max(i.atr)/max(CASE WHEN k=0 THEN close END)*100 AS atr_14_pct,
    CASE WHEN max(n)>=21 THEN max(CASE WHEN k=0 THEN volume END)/avg(CASE WHEN k BETWEEN 1 AND 20 THEN volume END) END AS volume_ratio_20d,
    CASE WHEN count(CASE WHEN bench_ret IS NOT NULL THEN ret END)>=40
         THEN covar_samp(CASE WHEN bench_ret IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN bench_ret END)
              / var_samp(CASE WHEN ret IS NOT NULL THEN bench_ret END) END AS beta_spy,
    CASE WHEN max(ret_n)>=20 THEN max(var_ret)*100 END AS var_95_1d_pct,
    CASE WHEN max(ret_n)>=20 THEN coalesce(avg(CASE WHEN k<252 AND ret<var_ret THEN ret END), max(var_ret))*100 END AS cvar_95_1d_pct,
    CASE WHEN max(ret_n)>=20 THEN min(CASE WHEN k<252 THEN ret END)*100 END AS worst_1d_pct,
    CAST(max(r.session_date) AS VARCHAR) AS price_as_of,
    CAST(max(n) AS BIGINT) AS observation_count
  FROM (
    SELECT b.*, x.ret AS bench_ret,
           max(CASE WHEN b.k<60 THEN b.close END) OVER (PARTITION BY b.ticker ORDER BY b.session_date) AS peak60,
           max(CASE WHEN b.k<252 THEN b.close END) OVER (PARTITION BY b.ticker ORDER BY b.session_date) AS peak_year,
           count(CASE WHEN b.k<252 THEN b.ret END) OVER (PARTITION BY b.ticker) AS ret_n,
           avg(CASE WHEN b.k<252 THEN b.ret END) OVER (PARTITION BY b.ticker)
             - 1.6448536269514722 * stddev_samp(CASE WHEN b.k<252 THEN b.ret END) OVER (PARTITION BY b.ticker) AS var_ret
    FROM {bars}_rows b LEFT JOIN bench_rows x ON b.session_date = x.session_date
  ) r JOIN {bars}_ind i ON r.ticker = i.ticker
  GROUP BY r.ticker
) m
"""


def _rows(bars: str) -> str:
    return f"""
SELECT *, n - j AS k, close / prev - 1 AS ret FROM (
  SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY ticker) AS n,
         lag(close) OVER w AS prev, max(close) OVER w AS peak
  FROM {bars} WINDOW w AS (PARTITION BY ticker ORDER BY session_date))
"""


def _fold(bars: str) -> str:
    """The indicators by stepping through each ticker's sessions one by one."""
    return f"""
SELECT ticker, j, n, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig,
       CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss,
       high - low AS trsum, CAST(NULL AS DOUBLE) AS atr
FROM {bars}_rows WHERE j = 1
UNION ALL
SELECT ticker, j, n, e12, e26,
       CASE WHEN j = 26 THEN e12 - e26 WHEN j > 26 THEN sig * 0.8 + (e12 - e26) * 0.2 END,
       gain, loss, trsum + tr,
       CASE WHEN j = 14 THEN (trsum + tr) / 14 WHEN j > 14 THEN (atr * 13 + tr) / 14 END
FROM (
  SELECT b.ticker, b.j, b.n, f.e12 * (1 - 2.0/13) + b.close * (2.0/13) AS e12,
         f.e26 * (1 - 2.0/27) + b.close * (2.0/27) AS e26, f.sig, f.trsum, f.atr,
         f.gain * (13.0/14) + greatest(b.close - b.prev, 0) / 14 AS gain,
         f.loss * (13.0/14) + greatest(b.prev - b.close, 0) / 14 AS loss,
         greatest(b.high - b.low, abs(b.high - b.prev), abs(b.low - b.prev)) AS tr
  FROM {bars}_fold f JOIN {bars}_rows b ON b.ticker = f.ticker AND b.j = f.j + 1)
"""


def _ind(bars: str) -> str:
    return f"""
SELECT ticker,
       CASE WHEN n >= 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi,
       CASE WHEN n >= 34 THEN e12 - e26 - sig END AS hist,
       CASE WHEN n >= 14 THEN atr END AS atr
FROM {bars}_fold WHERE j = n
"""


def _quick_ind(bars: str) -> str:
    """RSI alone, as weighted sums; the step-by-step fold checks the formula elsewhere."""
    return f"""
SELECT ticker, CASE WHEN n >= 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi,
       CAST(NULL AS DOUBLE) AS hist, CAST(NULL AS DOUBLE) AS atr
FROM (SELECT ticker, max(n) AS n,
             sum(greatest(close - prev, 0) / 14 * pow(13.0 / 14, n - j)) AS gain,
             sum(greatest(prev - close, 0) / 14 * pow(13.0 / 14, n - j)) AS loss
      FROM {bars}_rows WHERE j > 1 GROUP BY ticker)
"""


cte("bench_rows", _rows("fx_market"), "fx_market")
cte("fx_bars_rows", _rows("fx_bars"), "fx_bars")
cte("fx_bars_fold", _fold("fx_bars"), "fx_bars_rows")
cte("fx_bars_ind", _ind("fx_bars"), "fx_bars_fold")
cte("all_bars_rows", _rows("all_bars"), "all_bars")
cte("all_bars_ind", _quick_ind("all_bars"), "all_bars_rows")
cte("metrics", _metrics("fx_bars"), "fx_bars_rows", "fx_bars_ind", "bench_rows")
cte("all_metrics", _metrics("all_bars"), "all_bars_rows", "all_bars_ind", "bench_rows")

TECHNICAL_STATE = """CASE
  WHEN close IS NULL OR coalesce(observation_count, 0) < 21 OR ret_20d_pct IS NULL OR rsi_14 IS NULL THEN 'INSUFFICIENT_DATA'
  WHEN sma_50_gap_pct < -5 OR sma_200_gap_pct < -3 THEN 'WEAK'
  WHEN rsi_14 >= 75 THEN 'HOT' WHEN rsi_14 <= 30 THEN 'OVERSOLD'
  WHEN sma_50_gap_pct > 3 AND rel_spy_20d_pct > 0 THEN 'HEALTHY' ELSE 'NEUTRAL' END"""

cte("scored", f"""
SELECT *, CASE WHEN state = 'INSUFFICIENT_DATA' THEN -99 ELSE
    CASE WHEN sma_50_gap_pct > 0 THEN 1 ELSE 0 END + CASE WHEN sma_200_gap_pct > 0 THEN 1 ELSE 0 END
  + CASE WHEN ret_60d_pct > 0 THEN 1 ELSE 0 END + CASE WHEN rel_spy_20d_pct > 0 THEN 1 ELSE 0 END
  + CASE WHEN rsi_14 BETWEEN 45 AND 70 THEN 1 ELSE 0 END + CASE WHEN vol_30d_ann_pct <= 75 THEN 1 ELSE 0 END
  + CASE WHEN max_drawdown_1y_pct > -45 THEN 1 ELSE 0 END
  - CASE WHEN rsi_14 > 78 THEN 2 ELSE 0 END - CASE WHEN sma_200_gap_pct < -8 THEN 2 ELSE 0 END END AS score,
  CASE WHEN state = 'INSUFFICIENT_DATA' THEN ['INSUFFICIENT_HISTORY'] ELSE list_filter([
    CASE WHEN sma_50_gap_pct > 0 THEN 'ABOVE_SMA_50' END, CASE WHEN sma_200_gap_pct > 0 THEN 'ABOVE_SMA_200' END,
    CASE WHEN ret_60d_pct > 0 THEN 'RET_60D_POSITIVE' END, CASE WHEN rel_spy_20d_pct > 0 THEN 'STRONGER_THAN_SPY_20D' END,
    CASE WHEN rsi_14 BETWEEN 45 AND 70 THEN 'RSI_NOT_HOT' END, CASE WHEN vol_30d_ann_pct <= 75 THEN 'VOL_NOT_EXTREME' END,
    CASE WHEN max_drawdown_1y_pct > -45 THEN 'DRAWDOWN_NOT_EXTREME' END,
    CASE WHEN rsi_14 > 78 THEN 'RSI_HOT_PENALTY' END, CASE WHEN sma_200_gap_pct < -8 THEN 'FAR_BELOW_SMA_200' END],
    lambda x: x IS NOT NULL) END AS reasons,
  CASE WHEN close IS NULL THEN ['NO_PRICE'] ELSE list_filter([
    CASE WHEN rsi_14 >= 75 THEN 'RSI_HOT' END, CASE WHEN vol_30d_ann_pct > 90 THEN 'VOL_30D_HIGH' END,
    CASE WHEN max_drawdown_1y_pct <= -50 THEN 'DEEP_DRAWDOWN_1Y' END,
    CASE WHEN current_drawdown_1y_pct > -2 THEN 'NEAR_1Y_HIGH' END,
    CASE WHEN sma_50_gap_pct < 0 THEN 'BELOW_SMA_50' END,
    CASE WHEN rel_spy_20d_pct < 0 THEN 'WEAKER_THAN_SPY_20D' END], lambda x: x IS NOT NULL) END AS risks
FROM (SELECT *, {TECHNICAL_STATE} AS state FROM all_metrics)
""", "all_metrics")

cte("fx_universe_raw", """
SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN ' s' ELSE 'S' END || (s_suppkey - s_suppkey % 10 // 9) AS ticker,
       s_name AS company_name, n_name AS theme
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")

cte("fx_universe", """
SELECT upper(trim(ticker)) AS ticker, min(seq) AS seq, arg_min(company_name, seq) AS company_name,
       arg_min(theme, seq) AS theme
FROM fx_universe_raw GROUP BY 1
""", "fx_universe_raw")

cte("fx_holdings", """
SELECT 'A' || (l_orderkey % 50) AS account_ref,
       CASE WHEN l_suppkey % 17 = 0 THEN 'X' ELSE 'S' END || l_suppkey AS ticker,
       sum(l_quantity) AS shares, round(500 + 40 * ln(sum(l_extendedprice) / sum(l_quantity)) + 1e-7, 4) AS avg_cost,
       800.0 AS last_price,
       CASE WHEN l_suppkey % 3 = 0 THEN -3.0 END AS stop_loss_pct,
       CASE WHEN l_suppkey % 4 = 0 THEN 2.0 END AS trim_profit_pct
FROM lineitem GROUP BY l_orderkey % 50, l_suppkey
""")

cte("facts", """
SELECT *, CASE WHEN total_value <> 0 THEN value / total_value * 100 ELSE 0 END AS weight_pct,
       CASE WHEN avg_cost <> 0 AND latest <> 0 THEN (latest / avg_cost - 1) * 100 END AS pnl_pct
FROM (SELECT *, sum(value) OVER (PARTITION BY account_ref) AS total_value
      FROM (SELECT h.*, m.* EXCLUDE (ticker), coalesce(m.close, h.last_price) AS latest,
                   h.shares * coalesce(m.close, h.last_price) AS value
            FROM fx_holdings h LEFT JOIN all_metrics m ON h.ticker = m.ticker))
""", "fx_holdings", "all_metrics")

cte("fx_snapshots", """
SELECT 'P' || ticker AS account_ref, CAST(session_date AS VARCHAR) AS snapshot_date, ticker,
       10.0 + CASE WHEN CAST(substr(ticker, 2) AS INT) % 5 = 0 THEN year(session_date) % 2 ELSE 0 END AS shares,
       close * (10.0 + CASE WHEN CAST(substr(ticker, 2) AS INT) % 5 = 0 THEN year(session_date) % 2 ELSE 0 END) AS market_value
FROM fx_bars
""", "fx_bars")

cte("bench", """
SELECT
  max(CASE WHEN ticker='SPY' THEN close END) spy_c, max(CASE WHEN ticker='SPY' THEN ret_20d_pct END) spy_20,
  max(CASE WHEN ticker='SPY' THEN sma_50_gap_pct END) spy_g50, max(CASE WHEN ticker='SPY' THEN rsi_14 END) spy_rsi,
  max(CASE WHEN ticker='QQQ' THEN close END) qqq_c, max(CASE WHEN ticker='QQQ' THEN ret_20d_pct END) qqq_20,
  max(CASE WHEN ticker='QQQ' THEN sma_50_gap_pct END) qqq_g50, max(CASE WHEN ticker='QQQ' THEN rsi_14 END) qqq_rsi,
  max(CASE WHEN ticker='IWM' THEN close END) iwm_c, max(CASE WHEN ticker='IWM' THEN ret_20d_pct END) iwm_20,
  max(CASE WHEN ticker='IWM' THEN rel_spy_20d_pct END) iwm_rel,
  max(CASE WHEN ticker='IGV' THEN close END) igv_c, max(CASE WHEN ticker='IGV' THEN ret_20d_pct END) igv_20,
  max(CASE WHEN ticker='SMH' THEN close END) smh_c, max(CASE WHEN ticker='SMH' THEN ret_20d_pct END) smh_20,
  max(CASE WHEN ticker='SMH' THEN rel_spy_20d_pct END) smh_rel, max(CASE WHEN ticker='SMH' THEN rsi_14 END) smh_rsi,
  max(CASE WHEN ticker='RSP' THEN ret_20d_pct END) rsp_20, max(CASE WHEN ticker='RSP' THEN rel_spy_20d_pct END) rsp_rel,
  max(CASE WHEN ticker='HYG' THEN ret_20d_pct END) hyg_20, max(CASE WHEN ticker='IEF' THEN ret_20d_pct END) ief_20,
  max(CASE WHEN ticker='^VIX' THEN close END) vix_c, max(CASE WHEN ticker='^VIX' THEN ret_5d_pct END) vix_5
FROM all_metrics
""", "all_metrics")

REGIME = """CASE
  WHEN spy_c IS NULL OR qqq_c IS NULL OR iwm_c IS NULL OR igv_c IS NULL OR vix_c IS NULL OR smh_c IS NULL
    OR spy_20 IS NULL OR qqq_20 IS NULL OR iwm_20 IS NULL OR igv_20 IS NULL OR smh_20 IS NULL THEN 'INSUFFICIENT_DATA'
  WHEN spy_20 <= -5 OR qqq_20 <= -7 OR spy_g50 <= -3 OR qqq_g50 <= -4 OR vix_c >= 22 THEN 'RISK_OFF'
  WHEN spy_g50 > 0 AND qqq_g50 > 0 AND vix_c < 20 AND smh_20 > 0 THEN 'RISK_ON' ELSE 'MIXED' END"""

cte("fx_trades", """
SELECT 'A' || (o_custkey % 50) AS account_ref, upper(replace(p_brand, '#', '')) AS ticker,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
       l_quantity AS quantity, round(l_extendedprice / l_quantity + 1e-7, 4) AS price,
       CASE WHEN l_tax <> 0 THEN round(l_extendedprice * l_tax, 4) END AS fees,
       l_shipdate AS trade_time, l_orderkey || '-' || l_linenumber AS execution_id,
       l_orderkey * 8 + l_linenumber AS seq, l_partkey, l_suppkey,
       CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""")

cte("trade_rows", """
SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY account_ref, ticker) AS n,
       sum(signed) OVER (w ROWS UNBOUNDED PRECEDING) AS held_after
FROM fx_trades WINDOW w AS (PARTITION BY account_ref, ticker
                            ORDER BY trade_time, seq, l_partkey, l_suppkey, signed, price)
""", "fx_trades")

# Stepwise replay from an opening position of 20000 at 2000.
cte("replay", """
SELECT account_ref, ticker, CAST(0 AS BIGINT) AS j, max(n) AS n, CAST(20000 AS DOUBLE) AS q,
       CAST(40000000 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS realised, true AS complete
FROM trade_rows GROUP BY 1, 2
UNION ALL
SELECT r.account_ref, r.ticker, t.j, r.n, r.q + t.signed,
       CASE WHEN t.side = 'SELL' THEN r.cost - t.quantity * r.cost / r.q
            ELSE r.cost + t.quantity * t.price + coalesce(t.fees, 0) END,
       CASE WHEN t.side = 'SELL' THEN r.realised + t.quantity * (t.price - r.cost / r.q) - coalesce(t.fees, 0)
            ELSE r.realised END,
       r.complete AND NOT (t.side = 'SELL' AND t.fees IS NULL)
FROM replay r JOIN trade_rows t ON t.account_ref = r.account_ref AND t.ticker = r.ticker AND t.j = r.j + 1
""", "trade_rows")

cte("positions", """
SELECT account_ref, ticker, q AS shares, cost AS total_cost, cost / q AS avg_cost,
       CASE WHEN complete THEN realised END AS realised_pnl, complete AS realised_complete, n AS applied
FROM replay WHERE j = n
""", "replay")

cte("fx_fills", """
SELECT account_ref, CASE WHEN seq % 1913 = 0 THEN 'NO TICKER!' ELSE ticker END AS ticker, reward,
       CASE WHEN seq % 2503 = 0 THEN 'SHORT' WHEN reward AND seq % 2111 <> 0 THEN 'CREDIT' ELSE side END AS side,
       CASE WHEN seq % 2309 = 0 THEN 0 ELSE quantity END AS quantity, CASE WHEN seq % 2017 <> 0 THEN price END AS price, fees,
       seq % 2411 = 0 AS foreign_money, CASE WHEN seq % 2203 <> 0 THEN trade_time END AS trade_time,
       CASE WHEN seq % 3 = 0 THEN 'Name ' || (seq % 5) END AS company, seq, l_partkey, l_suppkey
FROM (SELECT *, seq % 499 = 0 OR seq % 2111 = 0 AS reward FROM fx_trades)
""", "fx_trades")

cte("ruled_fills", """
SELECT *, CASE WHEN trade_time IS NULL THEN 'TRADE_TIME_MISSING' WHEN (reward AND side <> 'CREDIT') OR (NOT reward AND side NOT IN ('BUY', 'SELL')) THEN 'UNSUPPORTED_SIDE'
               WHEN NOT regexp_full_match(ticker, '[A-Z][A-Z0-9.-]{0,9}') THEN 'INVALID_TICKER' WHEN foreign_money THEN 'NON_USD'
               WHEN quantity <= 0 THEN 'BAD_QUANTITY' WHEN NOT reward AND price IS NULL THEN 'BAD_PRICE' END AS rule FROM fx_fills
""", "fx_fills")

cte("fill_rows", """
SELECT *, row_number() OVER (PARTITION BY account_ref, ticker ORDER BY trade_time, seq, l_partkey, l_suppkey) AS j,
       count(*) OVER (PARTITION BY account_ref, ticker) AS n FROM ruled_fills WHERE rule IS NULL
""", "ruled_fills")

# The same replay with rewards, names and every flag carried along.
cte("broker_replay", """
SELECT account_ref, ticker, CAST(0 AS BIGINT) AS j, max(n) AS n, CAST(20000 AS DOUBLE) AS q, CAST(40000000 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS realised,
       true AS complete, true AS known, false AS fees_ok, CAST(NULL AS VARCHAR) AS company
FROM fill_rows GROUP BY 1, 2
UNION ALL
SELECT r.account_ref, r.ticker, t.j, r.n, r.q + CASE WHEN t.side = 'SELL' THEN -t.quantity ELSE t.quantity END,
       CASE WHEN t.reward OR (t.side = 'BUY' AND NOT r.known) THEN r.cost WHEN t.side = 'BUY' THEN r.cost + t.quantity * t.price + coalesce(t.fees, 0)
            WHEN r.known THEN r.cost - t.quantity * r.cost / r.q ELSE 0 END,
       CASE WHEN t.side = 'SELL' AND r.known THEN r.realised + t.quantity * (t.price - r.cost / r.q) - coalesce(t.fees, 0) ELSE r.realised END,
       r.complete AND NOT (t.side = 'SELL' AND (t.fees IS NULL OR NOT r.known)), r.known AND NOT t.reward, r.fees_ok AND NOT t.reward AND t.fees IS NOT NULL,
       coalesce(t.company, r.company)
FROM broker_replay r JOIN fill_rows t ON t.account_ref = r.account_ref AND t.ticker = r.ticker AND t.j = r.j + 1
""", "fill_rows")

cte("broker_positions", """
SELECT *, coalesce(refused, 0) = 0 AS fine FROM (SELECT * FROM broker_replay WHERE j = n) p
FULL JOIN (SELECT account_ref, ticker, count(*) AS refused, min(rule) AS first_rule FROM ruled_fills WHERE rule IS NOT NULL GROUP BY 1, 2) v USING (account_ref, ticker)
""", "broker_replay", "ruled_fills")

cte("fx_broker", """
SELECT event_id AS seq, event_id AS i,
  CASE WHEN event_id % 19 = 0 THEN 'other@example.com' ELSE ' Investor@Example.com' END AS source_account,
  CASE WHEN event_id % 17 = 0 THEN 'ads@other.example' ELSE 'trades@verified.example' END AS sender_addr,
  CASE WHEN event_id % 23 = 0 THEN 'Weekly news' ELSE ['Trade FILLED 7', 'Stock reward credited', 'trade filled'][event_id % 3 + 1] END AS subject,
  lower(['true', '1', 'Yes', 'no', 'FALSE'][event_id % 5 + 1]) IN ('true', '1', 'yes') AS affects,
  event_id % 13 <> 0 AS confirmed,
  CASE WHEN event_id % 7 = 0 THEN 'STOCK_REWARD' ELSE 'TRADE' END AS event_type,
  CASE WHEN event_id % 14 = 0 THEN 'CREDITED' WHEN event_id % 7 = 0 THEN 'FILLED' WHEN event_id % 11 = 0 THEN 'CANCELLED'
       WHEN event_id % 2 = 0 THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status,
  'A' || (user_id % 50) AS account_ref, 'T' || (user_id % 2) AS ticker, ts AS trade_time, event_id % 6 = 0 AS proxy,
  ts + CASE WHEN event_id % 6 = 0 THEN to_microseconds((event_id % 4) * 500000) ELSE to_microseconds(-(event_id % 9) * 60000000) END AS received
FROM events
""")

cte("broker_pos", """
SELECT *, affects AND confirmed AND ((event_type = 'TRADE' AND status IN ('FILLED', 'PARTIALLY_FILLED'))
          OR (event_type = 'STOCK_REWARD' AND status = 'CREDITED')) AS moves FROM fx_broker
""", "fx_broker")

cte("fx_overlays", """
SELECT DISTINCT account_ref, 'corr-' || account_ref AS correction_id,
       TIMESTAMP '2024-01-01' + to_hours(12 * CAST(substr(account_ref, 2) AS INT)) AS corrected_at,
       CAST(substr(account_ref, 2) AS INT) % 10 <> 9 AS active FROM fx_broker
""", "fx_broker")

cte("fx_statelog", """
SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, 'U' || user_id AS ticker, ts, event_id AS seq,
  CASE WHEN prev IS NULL THEN 'CANDIDATE_ADDED' WHEN event_id % 10 = 0 THEN 'CANDIDATE_REVIEWED' ELSE 'STATE_CHANGED' END AS event_type,
  CASE WHEN prev IS NULL OR event_id % 10 <> 0 THEN prev END AS previous_state,
  CASE WHEN prev IS NULL OR event_id % 10 <> 0 THEN mapped END AS new_state
FROM (SELECT *, lag(mapped) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
      FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'RESEARCH_QUEUE' WHEN 'view' THEN 'WATCHING'
              WHEN 'click' THEN 'NEAR_TRIGGER' WHEN 'purchase' THEN 'OPEN_CANDIDATE' ELSE 'PAUSED' END AS mapped FROM events))
""")

cte("state_rows", """
SELECT *, last_value(CASE WHEN event_type <> 'CANDIDATE_REVIEWED' THEN new_state END IGNORE NULLS) OVER (
         PARTITION BY ticker ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur
FROM fx_statelog
""", "fx_statelog")

cte("state_rules", """
SELECT *, CASE
  WHEN event_type = 'CANDIDATE_ADDED' AND cur IS NOT NULL THEN 'ALREADY_EXISTS'
  WHEN event_type <> 'CANDIDATE_ADDED' AND cur IS NULL THEN 'NO_SUCH_CANDIDATE'
  WHEN event_type = 'STATE_CHANGED' AND previous_state IS DISTINCT FROM cur THEN 'PREVIOUS_STATE_MISMATCH'
  WHEN event_type = 'STATE_CHANGED' AND new_state = cur THEN 'SAME_STATE'
  WHEN event_type = 'STATE_CHANGED' AND (cur || '>' || new_state) NOT IN (
    'RESEARCH_QUEUE>WATCHING', 'RESEARCH_QUEUE>PAUSED', 'WATCHING>RESEARCH_QUEUE', 'WATCHING>NEAR_TRIGGER', 'WATCHING>PAUSED',
    'NEAR_TRIGGER>WATCHING', 'NEAR_TRIGGER>OPEN_CANDIDATE', 'NEAR_TRIGGER>PAUSED', 'OPEN_CANDIDATE>NEAR_TRIGGER',
    'OPEN_CANDIDATE>WATCHING', 'OPEN_CANDIDATE>PAUSED', 'PAUSED>RESEARCH_QUEUE', 'PAUSED>WATCHING', 'PAUSED>NEAR_TRIGGER')
    THEN 'ILLEGAL_TRANSITION' END AS rule
FROM state_rows
""", "state_rows")

cte("state_final", """
SELECT ticker, arg_max(new_state, (ts, seq)) AS state FROM fx_statelog WHERE event_type <> 'CANDIDATE_REVIEWED' GROUP BY 1
""", "fx_statelog")

cte("fx_decision_log", """
SELECT 'D' || lpad(CAST(i AS VARCHAR), 9, '0') AS decision_id,
       'evt-D' || lpad(CAST(i AS VARCHAR), 9, '0') || '-' || k AS event_id, kind AS event_type,
       ts + to_seconds(CASE k WHEN 0 THEN -120 WHEN 1 THEN -60 WHEN 2 THEN CASE WHEN i % 19 = 0 THEN -90 ELSE 0 END ELSE 5 END) AS happened,
       CASE WHEN k = 2 AND i % 17 = 0 THEN 'mk-other' WHEN k > 0 THEN 'mk-' || i END AS marker,
       CASE WHEN k = 1 AND i % 29 <> 0 THEN 'brief' END AS subject, CASE WHEN k = 2 AND i % 31 <> 0 THEN 'mid' END AS message_id,
       k, i * 4 + k AS seq
FROM (SELECT event_id AS i, ts FROM events WHERE event_type = 'purchase')
CROSS JOIN (VALUES (0, 'DECISION_CREATED'), (1, 'EMAIL_SEND_INTENT'), (2, 'EMAIL_SENT'), (3, 'EMAIL_FAILED')) AS s(k, kind)
WHERE (k <> 1 OR i % 13 <> 0) AND (k <> 3 OR i % 23 = 0)
""")

cte("fx_raw_minutes", """
SELECT 'bar-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS bar_id, 'T' || (user_id % 2) AS ticker,
       date_trunc('minute', ts) AS bar_at, CAST(ts AS DATE) AS session_date, 'INTRADAY' AS bar_type, value AS close,
       date_trunc('minute', ts) + INTERVAL 1 MINUTE AS collected_at, ts AS seen_at, event_id AS seq
FROM events WHERE event_type <> 'purchase' AND value > 0
""")

cte("fx_sent_bars", """
SELECT bar_id, ticker, bar_at, close, collected_at, seq * 2 AS seq FROM fx_raw_minutes
UNION ALL SELECT bar_id, ticker, bar_at, close, collected_at, seq * 2 + 1 FROM fx_raw_minutes WHERE seq % 20 = 0
UNION ALL SELECT bar_id, ticker, bar_at, close + 1, collected_at, seq * 2 + 1000000000 FROM fx_raw_minutes WHERE seq % 33 = 0
""", "fx_raw_minutes")

cte("fx_messages", """
SELECT 'm' || conv_id AS source_message_id, turn AS seq,
       CASE role WHEN 'system' THEN 'QUARANTINED' WHEN 'user' THEN 'DISCOVERED' ELSE 'COMMITTED' END AS processing_status,
       sha256(text) AS content_hash, length(text) % 3 AS normalized_event_count
FROM conversations
""")

cte("msg", """
SELECT conv_id AS c, count(*) AS turns, arg_min(text, turn) AS text, conv_id // 10 AS b,
       CASE WHEN conv_id % 5 = 0 THEN 'QUARANTINED' WHEN conv_id % 3 = 0 THEN 'IGNORED' ELSE 'COMMITTED' END AS status,
       CASE WHEN conv_id % 5 <> 0 AND conv_id % 3 <> 0 THEN count(*) % 3 ELSE 0 END AS n_events
FROM conversations GROUP BY conv_id
""")

cte("batch", """
SELECT DISTINCT b, 'batch-' || lpad(CAST(b AS VARCHAR), 6, '0') AS batch_id FROM msg
""", "msg")

cte("chosen_facts", """
SELECT * FROM facts WHERE CAST(substr(account_ref, 2) AS BIGINT) % 2 = 1
  OR (close IS NOT NULL AND shares > 0 AND (CAST(substr(account_ref, 2) AS BIGINT) % 4 = 2 OR price_as_of = (SELECT max(price_as_of) FROM facts)))
""", "facts")

cte("ok", "SELECT b FROM batch WHERE b % 29 <> 0 AND b % 31 <> 0", "batch")

cte("placed", """
SELECT *, CAST(row_number() OVER (PARTITION BY b ORDER BY 'm' || c) - 1 AS VARCHAR) AS place FROM msg WHERE b IN (SELECT b FROM ok)
""", "msg", "ok")

AS_OF = "TIMESTAMP '2024-01-30 22:00:00'"

cte("fx_sessions", """
SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) AS INT) AS session_idx, session_date + INTERVAL 21 HOUR AS close_ts,
       lead(session_date) OVER (ORDER BY session_date) AS next_session
FROM (SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events) WHERE isodow(session_date) <= 5
""")

cte("fx_daily_closes", """
SELECT t AS ticker, e.session_date, close_ts AS bar_at, arg_max(value, (ts, event_id)) AS close
FROM (SELECT *, CAST(ts AS DATE) AS session_date, unnest(['T' || (user_id % 2), 'SPY']) AS t FROM events WHERE value > 0) e
JOIN fx_sessions s ON e.session_date = s.session_date WHERE ts <= close_ts AND (t <> 'SPY' OR day(e.session_date) % 7 <> 0)
GROUP BY 1, 2, 3
""", "fx_sessions")

cte("ledger_bars", """
SELECT 'INTRADAY' AS bar_type, ticker, bar_at, m.session_date, arg_max(close, (seen_at, seq)) AS close, bar_at + INTERVAL 1 MINUTE AS price_at
FROM fx_raw_minutes m JOIN fx_sessions s ON m.session_date = s.session_date WHERE collected_at <= close_ts GROUP BY ticker, bar_at, m.session_date
UNION ALL SELECT 'DAILY_CLOSE', ticker, bar_at, session_date, close, bar_at FROM fx_daily_closes
""", "fx_raw_minutes", "fx_sessions", "fx_daily_closes")

cte("vis_bars", f"""
SELECT * FROM ledger_bars WHERE price_at <= {AS_OF} AND (bar_type = 'INTRADAY' OR bar_at + INTERVAL 5 MINUTE <= {AS_OF})
""", "ledger_bars")

cte("dec", f"""
SELECT 'D' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS decision_id, event_id AS i, user_id, 'A' || (user_id % 50) AS account_ref,
       ts - INTERVAL 2 MINUTE AS created_at, CASE WHEN event_id % 11 <> 0 AND ts <= {AS_OF} THEN ts END AS delivered_at,
       coalesce(CASE WHEN event_id % 11 <> 0 AND ts <= {AS_OF} THEN ts END, ts - INTERVAL 2 MINUTE) AS decision_at
FROM events WHERE event_type = 'purchase' AND ts - INTERVAL 2 MINUTE <= {AS_OF}
""")

cte("dec_h", """
SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN action IN ('HOLD', 'WATCH') THEN 1.0 END AS exposure FROM (
  SELECT *, 'T' || (user_id % 2) AS ticker, ['HOLD', 'WATCH', 'TRIM', 'ADD', 'SELL_REVIEW'][i % 5 + 1] AS action,
         CASE WHEN i % 3 = 0 THEN 0.5 END AS given, CASE WHEN i % 4 <> 0 THEN CAST(i % 50 + 5 AS DOUBLE) END AS start_shares FROM dec
  UNION ALL SELECT *, 'T' || (1 - user_id % 2), 'HOLD', NULL, 10.0 FROM dec WHERE i % 2 = 0)
""", "dec")

cte("refs", f"""
SELECT d.*, s.session_date, s.session_idx, s.close_ts, r.close AS ref_raw, r.price_at AS ref_raw_at,
  CASE WHEN delivered_at IS NULL THEN 'NOT_DELIVERED' WHEN s.close_ts IS NULL OR start + INTERVAL 1 MINUTE > s.close_ts THEN 'NOT_APPLICABLE'
       WHEN r.close IS NOT NULL THEN 'MATURED' WHEN {AS_OF} < delivered_at + INTERVAL 6 MINUTE THEN 'PENDING' ELSE 'PENDING_DATA' END AS rstat
FROM (SELECT *, CASE WHEN delivered_at > date_trunc('minute', delivered_at) THEN date_trunc('minute', delivered_at) + INTERVAL 1 MINUTE
                     ELSE delivered_at END AS start FROM dec_h) d
LEFT JOIN fx_sessions s ON CAST(decision_at AS DATE) = s.session_date
LEFT JOIN vis_bars r ON r.bar_type = 'INTRADAY' AND r.ticker = d.ticker AND r.bar_at = start
""", "dec_h", "fx_sessions", "vis_bars")

cte("near", """
SELECT decision_id, r.ticker, b.close AS near_close, b.price_at AS near_at
FROM refs r JOIN vis_bars b ON b.bar_type = 'INTRADAY' AND b.ticker = r.ticker
 AND b.price_at BETWEEN decision_at + INTERVAL 45 MINUTE AND decision_at + INTERVAL 75 MINUTE
QUALIFY row_number() OVER (PARTITION BY decision_id, r.ticker ORDER BY abs(epoch_us(b.price_at) - epoch_us(decision_at) - 3600000000),
                           b.price_at < decision_at + INTERVAL 1 HOUR, b.price_at) = 1
""", "refs", "vis_bars")

cte("hor", f"""
SELECT *, CASE WHEN stat = 'MATURED' THEN CASE WHEN horizon = '1h' THEN near_close ELSE day_close END END AS end_price,
          CASE WHEN stat = 'MATURED' THEN CASE WHEN horizon = '1h' THEN near_at ELSE tclose END END AS end_at
FROM (SELECT r.decision_id, r.ticker, r.account_ref, r.action, r.exposure, r.start_shares, r.decision_at, h.horizon, h.k,
        CASE WHEN rstat = 'MATURED' THEN ref_raw END AS ref, CASE WHEN rstat = 'MATURED' THEN ref_raw_at END AS ref_at,
        n.near_close, n.near_at, c.close AS day_close, t.close_ts AS tclose,
        CASE WHEN rstat <> 'MATURED' THEN rstat
             WHEN h.horizon = '1h' THEN CASE WHEN decision_at + INTERVAL 1 HOUR > r.close_ts THEN 'NOT_APPLICABLE'
                  WHEN {AS_OF} < decision_at + INTERVAL 1 HOUR THEN 'PENDING' WHEN n.near_at IS NULL THEN 'PENDING_DATA' ELSE 'MATURED' END
             WHEN t.close_ts IS NULL OR {AS_OF} < t.close_ts THEN 'PENDING'
             WHEN b.close IS NULL OR c.close IS NULL THEN 'PENDING_DATA' ELSE 'MATURED' END AS stat
      FROM refs r CROSS JOIN (VALUES ('1h', 0), ('close', 0), ('1d', 1), ('5d', 5), ('20d', 20)) h(horizon, k)
      LEFT JOIN near n ON n.decision_id = r.decision_id AND n.ticker = r.ticker
      LEFT JOIN fx_sessions t ON t.session_idx = r.session_idx + h.k
      LEFT JOIN vis_bars b ON b.bar_type = 'DAILY_CLOSE' AND b.ticker = 'SPY' AND b.session_date = t.session_date
      LEFT JOIN vis_bars c ON c.bar_type = 'DAILY_CLOSE' AND c.ticker = r.ticker AND c.session_date = t.session_date)
""", "refs", "near", "fx_sessions", "vis_bars")

cte("hold_path", """
SELECT decision_id, ticker, horizon, least(min(close / peak - 1), 0) * 100 AS hold_dd
FROM (SELECT h.decision_id, h.ticker, h.horizon, b.close,
             greatest(ref, max(b.close) OVER (PARTITION BY h.decision_id, h.ticker, h.horizon
                      ORDER BY b.price_at, b.bar_type = 'DAILY_CLOSE' ROWS UNBOUNDED PRECEDING)) AS peak
      FROM hor h JOIN vis_bars b ON b.ticker = h.ticker AND b.price_at > h.ref_at AND b.price_at <= h.end_at)
GROUP BY 1, 2, 3
""", "hor", "vis_bars")

cte("ev_trades", f"""
SELECT 'A' || (user_id % 50) AS account_ref, 'T' || (user_id % 2) AS ticker, event_type = 'error' AS sell,
       CAST(event_id % 5 + 1 AS DOUBLE) AS quantity, value AS price, CASE WHEN event_id % 97 <> 0 THEN 0.25 END AS fees, ts AS trade_time,
       event_id % 89 = 0 AS proxy, event_id AS seq
FROM events WHERE event_type IN ('signup', 'error') AND value > 0 AND ts + INTERVAL 20 SECOND <= {AS_OF}
 AND ts + CASE WHEN event_id % 13 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 30 SECOND END <= {AS_OF}
""")

cte("moves", """
SELECT h.decision_id, h.ticker, h.horizon, h.ref, h.start_shares, t.trade_time AS at_, 0 AS kind, t.seq,
       CASE WHEN sell THEN -quantity ELSE quantity END AS dq,
       CASE WHEN sell THEN quantity * price - coalesce(fees, 0) ELSE -quantity * price - coalesce(fees, 0) END AS dc,
       NULL AS price, proxy, fees IS NULL AS nofee
FROM hor h JOIN ev_trades t ON t.account_ref = h.account_ref AND t.ticker = h.ticker AND t.trade_time > h.decision_at AND t.trade_time <= h.end_at
""", "hor", "ev_trades")

cte("actual", """
SELECT decision_id, ticker, horizon, max(start_shares) AS s0, arg_min(CASE WHEN proxy THEN 'TRADE_TIME_IS_PROXY' ELSE 'FEES_MISSING' END, (at_, seq)) FILTER (WHERE proxy OR nofee) AS flaw,
       min(held) FILTER (WHERE kind = 0) AS least, max(v) FILTER (WHERE kind = 2) AS end_value, max(ref) AS ref,
       min(v / peak - 1) AS worst
FROM (SELECT *, greatest(start_shares * ref, max(v) OVER (PARTITION BY decision_id, ticker, horizon ORDER BY at_, kind, seq ROWS UNBOUNDED PRECEDING)) AS peak
  FROM (SELECT *, CASE WHEN kind >= 1 THEN held * price + cash END AS v
    FROM (SELECT *, start_shares + sum(dq) OVER w AS held, sum(dc) OVER w AS cash
          FROM (SELECT * FROM moves UNION ALL
                SELECT h.decision_id, h.ticker, h.horizon, h.ref, h.start_shares, b.price_at, 1, CASE WHEN b.bar_type = 'DAILY_CLOSE' THEN 1 ELSE 0 END, 0, 0, b.close, false, false
                FROM hor h JOIN vis_bars b ON b.ticker = h.ticker AND b.price_at > h.ref_at AND b.price_at <= h.end_at
                WHERE (h.decision_id, h.ticker, h.horizon) IN (SELECT decision_id, ticker, horizon FROM moves)
                UNION ALL
                SELECT decision_id, ticker, horizon, ref, start_shares, end_at, 2, 0, 0, 0, end_price, false, false FROM hor
                WHERE (decision_id, ticker, horizon) IN (SELECT decision_id, ticker, horizon FROM moves))
          WINDOW w AS (PARTITION BY decision_id, ticker, horizon ORDER BY at_, kind, seq ROWS UNBOUNDED PRECEDING))))
GROUP BY 1, 2, 3
""", "moves", "hor", "vis_bars")

cte("outcome", """
SELECT h.*, (end_price / h.ref - 1) * 100 AS hold_return, exposure * (end_price / h.ref - 1) * 100 - abs(1 - exposure) * 10 / 100 AS advice_return,
  CASE WHEN end_at IS NOT NULL THEN coalesce(p.hold_dd, 0) END AS hold_dd,
  CASE WHEN end_at IS NULL THEN 'NOT_MATURE' WHEN a.ref IS NOT NULL THEN 'TRADED_AFTER' ELSE 'NO_TRADE' END AS relation,
  CASE WHEN a.ref IS NULL THEN NULL WHEN a.s0 IS NULL THEN 'START_SHARES_MISSING' WHEN flaw IS NOT NULL THEN flaw
       WHEN least < 0 THEN 'SOLD_MORE_THAN_HELD' END AS note,
  end_value, a.s0, a.worst, a.ref AS traded_ref
FROM hor h LEFT JOIN hold_path p ON p.decision_id = h.decision_id AND p.ticker = h.ticker AND p.horizon = h.horizon
LEFT JOIN actual a ON a.decision_id = h.decision_id AND a.ticker = h.ticker AND a.horizon = h.horizon
""", "hor", "hold_path", "actual")

cte("scored_outcome", """
SELECT *, CASE WHEN traded_ref IS NOT NULL AND note IS NULL THEN (end_value / (s0 * ref) - 1) * 100 WHEN traded_ref IS NULL THEN hold_return END AS actual_return,
  CASE WHEN traded_ref IS NOT NULL AND note IS NULL THEN least(worst, 0) * 100 WHEN traded_ref IS NULL THEN hold_dd END AS actual_dd
FROM outcome
""", "outcome")

cte("seq", """
SELECT b.ticker, b.session_date, b.close, m.close AS bench, c.session_idx,
       b.close / lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.session_date) - 1 AS step
FROM fx_bars b JOIN fx_market m ON b.session_date = m.session_date
JOIN (SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) AS INT) AS session_idx FROM fx_market) c ON b.session_date = c.session_date
""", "fx_bars", "fx_market")

cte("decision_rules", """
SELECT *, CASE WHEN event_type = 'DECISION_CREATED' THEN NULL WHEN happened < before THEN 'TIME_OUT_OF_ORDER'
         WHEN event_type = 'EMAIL_SEND_INTENT' THEN CASE WHEN subject IS NULL THEN 'SUBJECT_MISSING' END
         WHEN intents <> 1 THEN 'NO_SINGLE_INTENT' WHEN marker <> im THEN 'MARKER_DIFFERS'
         WHEN event_type = 'EMAIL_SENT' AND message_id IS NULL THEN 'MESSAGE_ID_MISSING'
         WHEN event_type = 'EMAIL_FAILED' AND sent > 0 THEN 'FAILED_AFTER_SENT' END AS rule
FROM (SELECT *, max(happened) OVER w AS before, count(CASE WHEN event_type = 'EMAIL_SEND_INTENT' THEN 1 END) OVER w AS intents,
             count(CASE WHEN event_type = 'EMAIL_SENT' THEN 1 END) OVER w AS sent,
             max(CASE WHEN event_type = 'EMAIL_SEND_INTENT' THEN marker END) OVER w AS im
      FROM fx_decision_log WINDOW w AS (PARTITION BY decision_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""", "fx_decision_log")

# Replay from nothing; a sell of more than is held changes nothing.
cte("live_rows", """
SELECT *, row_number() OVER (PARTITION BY account_ref, ticker ORDER BY trade_time, seq, l_partkey * 100000 + l_suppkey) AS lj FROM trade_rows
""", "trade_rows")

cte("live", """
SELECT account_ref, ticker, CAST(0 AS BIGINT) AS lj, max(n) AS n, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS realised,
       CAST(0 AS BIGINT) AS refused FROM live_rows GROUP BY 1, 2
UNION ALL
SELECT r.account_ref, r.ticker, t.lj, r.n,
       CASE WHEN t.side = 'SELL' AND t.quantity > r.q THEN r.q ELSE r.q + t.signed END,
       CASE WHEN t.side = 'SELL' AND t.quantity > r.q THEN r.cost WHEN t.side = 'SELL' AND t.quantity = r.q THEN 0
            WHEN t.side = 'SELL' THEN r.cost - t.quantity * r.cost / r.q ELSE r.cost + t.quantity * t.price + coalesce(t.fees, 0) END,
       CASE WHEN t.side = 'SELL' AND t.quantity <= r.q THEN r.realised + t.quantity * (t.price - r.cost / r.q) - coalesce(t.fees, 0) ELSE r.realised END,
       r.refused + CASE WHEN t.side = 'SELL' AND t.quantity > r.q THEN 1 ELSE 0 END
FROM live r JOIN live_rows t ON t.account_ref = r.account_ref AND t.ticker = r.ticker AND t.lj = r.lj + 1
""", "live_rows")
