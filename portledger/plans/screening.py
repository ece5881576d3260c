"""Plans over metrics: market state, candidate screening, holdings and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from portledger.operators import holdings as h
from portledger.operators import market, screen
from portledger.operators import metrics as m
from portledger.plans.ctes import REGIME, TECHNICAL_STATE
from portledger.plans.fixtures import (
    fx_bars,
    fx_benchmarks,
    fx_holdings,
    fx_market,
    fx_snapshots,
    fx_universe_raw,
)
from portledger.plans.registry import plan, rounded
from portledger.session import scratch_path
from portledger.sources import writers
from portledger.sources.staging import staged


def all_metrics(spark, sf_dir):
    bars = fx_bars(spark, sf_dir).unionByName(fx_benchmarks(spark, sf_dir))
    return m.quote_metrics(bars, fx_market(spark, sf_dir))


def bench_metrics(spark, sf_dir):
    return m.quote_metrics(fx_benchmarks(spark, sf_dir), fx_market(spark, sf_dir))


@plan(
    "j2_technical_state",
    f"SELECT ticker, {TECHNICAL_STATE} AS state FROM all_metrics",
    uses=("all_metrics",),
)
def technical_state(spark, sf_dir):
    return all_metrics(spark, sf_dir).select("ticker", market.technical_state().alias("state"))


@plan(
    "j3_market_regime",
    f"""SELECT {REGIME} AS regime, '' AS missing, round(spy_20, 6) AS spy_20d, round(qqq_20, 6) AS qqq_20d,
               round(smh_rel, 6) AS semis_rel_20d, round(vix_c, 6) AS vix FROM bench""",
    uses=("bench",),
)
def market_regime(spark, sf_dir):
    return rounded(market.market_regime(bench_metrics(spark, sf_dir)))


HEAT_VOTES = """(SELECT *,
         CASE WHEN spy_20 > 0 THEN 1 ELSE -1 END + CASE WHEN qqq_20 > 0 THEN 1 ELSE -1 END
         + CASE WHEN rsp_rel >= 0 THEN 1 ELSE -1 END + CASE WHEN iwm_rel >= 0 THEN 1 ELSE -1 END
         + CASE WHEN hyg_20 - ief_20 >= 0 THEN 1 ELSE -1 END + CASE WHEN smh_rel >= 0 THEN 1 ELSE -1 END
         + CASE WHEN vix_c >= 22 THEN -2 WHEN vix_c >= 18 THEN -1 WHEN vix_c < 16 THEN 1 ELSE 0 END
         + CASE WHEN vix_5 >= 20 THEN -1 ELSE 0 END AS score,
         CASE WHEN spy_rsi >= 70 THEN 1 ELSE 0 END + CASE WHEN qqq_rsi >= 70 THEN 1 ELSE 0 END
         + CASE WHEN smh_rsi >= 70 THEN 1 ELSE 0 END AS hot FROM bench)"""


@plan(
    "j4_market_heat",
    """SELECT CASE WHEN score >= 4 AND hot >= 2 AND vix_c < 16 THEN 'OVERHEATED' WHEN score >= 4 THEN 'HOT'
         WHEN score >= 2 THEN 'NEUTRAL_WARM' WHEN score >= 0 THEN 'NEUTRAL' WHEN score >= -2 THEN 'COOL'
         ELSE 'RISK_AVERSE' END AS heat, score, hot AS hot_rsi_count, '' AS missing
       FROM """
    + HEAT_VOTES,
    uses=("bench",),
)
def market_heat(spark, sf_dir):
    return market.market_heat(bench_metrics(spark, sf_dir))


@plan(
    "e8_heat_score",
    "SELECT score FROM " + HEAT_VOTES,
    uses=("bench",),
)
def heat_score(spark, sf_dir):
    return market.market_heat(bench_metrics(spark, sf_dir)).select("score")


@plan(
    "e9_hot_rsi_count",
    """SELECT count(*) AS hot_rsi_count FROM all_metrics WHERE ticker IN ('SPY', 'QQQ', 'SMH') AND rsi_14 >= 70""",
    uses=("all_metrics",),
)
def hot_rsi_count(spark, sf_dir):
    return market.hot_rsi_count(bench_metrics(spark, sf_dir))


@plan(
    "j5_market_environment",
    f"""SELECT CAST(list_position(['SPY','QQQ','IWM','SMH','SOXX','IGV','RSP','HYG','IEF','^VIX'], ticker) - 1 AS INT) AS rank,
               ticker, b.name, b.role, round(close, 6) AS close, price_as_of, round(ret_1d_pct, 6) AS ret_1d_pct,
               round(ret_5d_pct, 6) AS ret_5d_pct, round(ret_20d_pct, 6) AS ret_20d_pct, round(ret_60d_pct, 6) AS ret_60d_pct,
               CASE WHEN ticker <> 'SPY' THEN round(rel_spy_20d_pct, 6) END AS rel_spy_20d_pct, round(rsi_14, 6) AS rsi_14,
               CASE WHEN ticker = '^VIX' THEN 'VOLATILITY' ELSE {TECHNICAL_STATE} END AS state
        FROM all_metrics JOIN (VALUES """
    + ", ".join(f"('{t}', '{n}', '{r}')" for t, n, r in market.BENCHMARK_LABELS)
    + ") AS b(t, name, role) ON ticker = b.t",
    uses=("all_metrics",),
)
def market_environment(spark, sf_dir):
    return rounded(market.market_environment(bench_metrics(spark, sf_dir)))


@plan(
    "j6_candidate_score",
    "SELECT ticker, state, score, array_to_string(reasons, '; ') AS reasons FROM scored",
    uses=("scored",),
)
def candidate_score(spark, sf_dir):
    return screen.candidate_score(all_metrics(spark, sf_dir)).select(
        "ticker", "state", "score", F.concat_ws("; ", "reasons").alias("reasons")
    )


@plan(
    "j7_opening_risks",
    "SELECT ticker, score, array_to_string(risks, '; ') AS risks FROM scored",
    uses=("scored",),
)
def opening_risks(spark, sf_dir):
    return screen.opening_risks(all_metrics(spark, sf_dir)).select(
        "ticker", "score", F.concat_ws("; ", "risks").alias("risks")
    )


@plan(
    "c10_exclude_severe_risk",
    """SELECT ticker, score FROM scored WHERE score >= 5 AND NOT list_has_any(risks,
         ['RSI_HOT', 'VOL_30D_HIGH', 'BELOW_SMA_50', 'WEAKER_THAN_SPY_20D'])""",
    uses=("scored",),
)
def exclude_severe(spark, sf_dir):
    scored = screen.opening_risks(all_metrics(spark, sf_dir))
    return screen.exclude_severe(scored).select("ticker", "score")


@plan(
    "a8_universe_load",
    "SELECT seq, ticker, company_name, theme FROM fx_universe",
    uses=("fx_universe",),
)
def universe_load(spark, sf_dir):
    return screen.load_universe(fx_universe_raw(spark, sf_dir))


def _held(spark, sf_dir):
    """Tickers held by account A7."""
    return fx_holdings(spark, sf_dir).filter(
        (F.col("account_ref") == "A7") & (F.col("shares") > 500)
    ).select("ticker")


HELD_SQL = "SELECT ticker FROM fx_holdings WHERE account_ref = 'A7' AND shares > 500"


@plan(
    "d4_held_and_benchmark_anti",
    f"SELECT ticker, company_name FROM fx_universe WHERE ticker NOT IN ({HELD_SQL})",
    uses=("fx_universe", "fx_holdings"),
)
def unheld(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    return screen.unheld(universe, _held(spark, sf_dir)).select("ticker", "company_name")


@plan(
    "d5_metrics_exist_semi",
    "SELECT ticker, theme FROM fx_universe WHERE ticker IN (SELECT ticker FROM all_metrics WHERE close IS NOT NULL)",
    uses=("fx_universe", "all_metrics"),
)
def priced(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    return screen.priced(universe, all_metrics(spark, sf_dir)).select("ticker", "theme")


@plan(
    "d3_metrics_left_join",
    """SELECT t.ticker, round(m.close, 6) AS close, coalesce(m.observation_count, 0) AS observation_count,
              CASE WHEN m.ticker IS NULL THEN 'missing price data' ELSE '' END AS data_note
       FROM (SELECT DISTINCT ticker FROM fx_holdings) t LEFT JOIN all_metrics m ON t.ticker = m.ticker""",
    uses=("fx_holdings", "all_metrics"),
)
def metrics_left_join(spark, sf_dir):
    out = m.complete_metrics(fx_holdings(spark, sf_dir), all_metrics(spark, sf_dir))
    return rounded(out.select("ticker", "close", "observation_count", "data_note"))


@plan(
    "j8_opening_candidates",
    f"""SELECT u.ticker, u.company_name, u.theme, round(close, 6) AS close, price_as_of, round(ret_20d_pct, 6) AS ret_20d_pct,
              round(ret_60d_pct, 6) AS ret_60d_pct, round(rel_spy_20d_pct, 6) AS rel_spy_20d_pct, round(rsi_14, 6) AS rsi_14,
              score, array_to_string(reasons[1:3], '; ') AS reason_text,
              CASE WHEN len(risks) > 0 THEN array_to_string(risks[1:3], '; ') ELSE 'UNVERIFIED_NEWS_EARNINGS_VALUATION' END AS risk_text
       FROM fx_universe u JOIN scored s ON u.ticker = s.ticker
       WHERE u.ticker NOT IN ({HELD_SQL}) AND score >= 5 AND NOT list_has_any(risks,
         ['RSI_HOT', 'VOL_30D_HIGH', 'BELOW_SMA_50', 'WEAKER_THAN_SPY_20D'])
       ORDER BY score DESC, round(rel_spy_20d_pct, 1) DESC, round(ret_20d_pct, 1) DESC, seq LIMIT 3""",
    uses=("fx_universe", "scored", "fx_holdings"),
)
def opening_candidates(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    return rounded(
        screen.opening_candidates(universe, all_metrics(spark, sf_dir), _held(spark, sf_dir))
    )


@plan(
    "g1_discovery_topk",
    """SELECT ticker, score FROM (SELECT u.ticker, s.score, row_number() OVER (ORDER BY s.score DESC,
         round(rel_spy_20d_pct, 1) DESC, round(ret_20d_pct, 1) DESC, seq) AS r
       FROM fx_universe u JOIN scored s ON u.ticker = s.ticker) WHERE r <= 10""",
    uses=("fx_universe", "scored"),
)
def discovery_topk(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    scored = screen.candidate_score(universe.join(all_metrics(spark, sf_dir), "ticker"))
    return screen.top_discoveries(scored, 10).select("ticker", "score")


@plan(
    "g1_discovery_topk_by_theme",
    """SELECT theme, ticker, score, CAST(r AS INT) AS rank FROM (SELECT theme, u.ticker, s.score,
         row_number() OVER (PARTITION BY theme ORDER BY s.score DESC,
         round(rel_spy_20d_pct, 1) DESC, round(ret_20d_pct, 1) DESC, seq) AS r
       FROM fx_universe u JOIN scored s ON u.ticker = s.ticker) WHERE r <= 3""",
    uses=("fx_universe", "scored"),
)
def discovery_topk_by_theme(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    scored = screen.candidate_score(universe.join(all_metrics(spark, sf_dir), "ticker"))
    best = screen.top_discoveries_by(scored, ["theme"], 3)
    return best.select("theme", "ticker", "score", "rank")


@plan(
    "g2_watchlist_rank",
    """SELECT u.ticker, u.seq, CASE WHEN s.score > -90 THEN s.score END AS shown_score,
              array_to_string(reasons[1:3], '; ') AS point_text
       FROM fx_universe u LEFT JOIN scored s ON u.ticker = s.ticker WHERE s.ticker IS NOT NULL""",
    uses=("fx_universe", "scored"),
)
def watchlist_rank(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    return screen.watchlist_rank(universe, all_metrics(spark, sf_dir)).select(
        "ticker", "seq", "shown_score", "point_text"
    )


@plan(
    "j9_persistent_candidates",
    """SELECT u.ticker, CASE WHEN seq % 2 = 0 THEN 'WATCHING' ELSE 'RESEARCH_QUEUE' END AS funnel_state,
              CASE WHEN seq % 3 <> 0 THEN CAST(seq % 101 AS DOUBLE) END AS selection_score,
              CAST(100 - seq % 40 AS DOUBLE) AS coverage_pct, round(close, 6) AS close, price_as_of,
              round(ret_1d_pct, 6) AS ret_1d_pct, round(ret_20d_pct, 6) AS ret_20d_pct, round(rel_spy_20d_pct, 6) AS rel_spy_20d_pct,
              CASE WHEN score >= 0 THEN score || '/7' ELSE 'NA' END AS prescreen,
              CASE WHEN len(risks) > 0 THEN array_to_string(risks[1:2], '; ') ELSE 'NO_HARD_RISK' END AS risk_text,
              u.theme AS next_event_at, NULL AS entry_condition, NULL AS invalidation_condition
       FROM fx_universe u JOIN scored s ON u.ticker = s.ticker""",
    uses=("fx_universe", "scored"),
)
def persistent_candidates(spark, sf_dir):
    universe = screen.load_universe(fx_universe_raw(spark, sf_dir))
    watch = universe.select(
        "ticker",
        F.when(F.col("seq") % 2 == 0, "WATCHING").alias("state"),
        F.when(F.col("seq") % 3 != 0, (F.col("seq") % 101).cast("string")).otherwise("").alias("selection_score"),
        (100 - F.col("seq") % 40).cast("string").alias("coverage_pct"),
        F.col("theme").alias("next_event_at"),
        F.lit(" ").alias("entry_condition"),
        F.lit(None).cast("string").alias("invalidation_condition"),
    )
    return rounded(screen.persistent_candidates(watch, all_metrics(spark, sf_dir)))


def facts(spark, sf_dir):
    return h.holding_facts(fx_holdings(spark, sf_dir), all_metrics(spark, sf_dir))


@plan(
    "j11_holding_facts",
    """SELECT account_ref, ticker, round(latest, 6) AS latest, round(value, 4) AS value, round(weight_pct, 6) AS weight_pct,
              round(pnl_pct, 6) AS pnl_pct, value <= 0 AS missing_value, avg_cost <= 0 AS missing_cost FROM facts""",
    uses=("facts",),
)
def holding_facts(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "account_ref", "ticker", F.round("latest", 6).alias("latest"), F.round("value", 4).alias("value"),
        F.round("weight_pct", 6).alias("weight_pct"), F.round("pnl_pct", 6).alias("pnl_pct"),
        "missing_value", "missing_cost",
    )


@plan(
    "e12_position_weight",
    """SELECT account_ref, ticker, round(weight_pct, 6) AS weight_pct FROM facts""",
    uses=("facts",),
)
def position_weight(spark, sf_dir):
    return rounded(facts(spark, sf_dir).select("account_ref", "ticker", "weight_pct"))


@plan(
    "e12_position_weight_without_prices",
    """SELECT account_ref, ticker, round(shares / sum(shares) OVER (PARTITION BY account_ref) * 100, 6) AS weight_pct
       FROM fx_holdings""",
    uses=("fx_holdings",),
)
def position_weight_without_prices(spark, sf_dir):
    """No ticker has a price: the values the holdings came with decide."""
    valued = fx_holdings(spark, sf_dir).withColumn("market_value", F.col("shares"))
    no_prices = spark.createDataFrame([], "ticker string, close double")
    return rounded(h.holding_facts(valued, no_prices).select("account_ref", "ticker", "weight_pct"))


@plan(
    "j10_holding_action",
    f"""SELECT account_ref, ticker, CASE
          WHEN close IS NULL THEN 'WATCH' WHEN pnl_pct <= stop_loss_pct THEN 'SELL_REVIEW'
          WHEN state = 'INSUFFICIENT_DATA' OR regime = 'INSUFFICIENT_DATA' THEN 'WATCH'
          WHEN sma_200_gap_pct < -5 AND rel_spy_60d_pct < -5 THEN 'WATCH'
          WHEN pnl_pct >= trim_profit_pct AND rsi_14 >= 75 THEN 'TRIM'
          WHEN regime = 'RISK_OFF' AND ret_20d_pct < 0 AND rel_spy_20d_pct < 0 THEN 'WATCH'
          WHEN regime = 'RISK_ON' AND state = 'HEALTHY' AND rsi_14 < 70 AND (vol_30d_ann_pct IS NULL OR vol_30d_ann_pct <= 100) THEN 'ADD'
          ELSE 'HOLD' END AS action, state
        FROM (SELECT *, {TECHNICAL_STATE} AS state, (SELECT {REGIME} FROM bench) AS regime FROM facts)""",
    uses=("facts", "bench"),
)
def holding_action(spark, sf_dir):
    regime = market.market_regime(bench_metrics(spark, sf_dir))
    return h.with_actions(facts(spark, sf_dir), regime).select(
        "account_ref", "ticker", "action", "state"
    )


@plan(
    "j12_position_snapshot_rows",
    """SELECT account_ref, price_as_of AS snapshot_date, ticker, shares, avg_cost, round(close, 6) AS last_price,
              round(shares * close, 4) AS market_value, round(shares * avg_cost, 4) AS cost_basis,
              round(shares * close - shares * avg_cost, 4) AS unrealized_pnl,
              round((shares * close - shares * avg_cost) / (shares * avg_cost) * 100, 6) AS unrealized_pnl_pct
       FROM facts""",
    uses=("facts",),
)
def position_snapshot(spark, sf_dir):
    out = h.position_snapshot(facts(spark, sf_dir))
    money = ("market_value", "cost_basis", "unrealized_pnl")
    return rounded(out.withColumns({c: F.round(c, 4) for c in money}))


@plan(
    "a9_snapshot_guard",
    """SELECT account_ref, count(*) AS holdings,
              CASE WHEN count(*) FILTER (WHERE shares <= 0) > 0 THEN 'SHARES_UNCONFIRMED'
                   WHEN count(*) FILTER (WHERE close IS NULL) > 0 THEN 'PRICE_MISSING'
                   WHEN count(DISTINCT price_as_of) > 1 THEN 'MIXED_PRICE_DATES' ELSE 'WRITE' END AS decision,
              CASE WHEN count(DISTINCT price_as_of) = 1 THEN min(price_as_of) END AS snapshot_date
       FROM facts GROUP BY 1""",
    uses=("facts",),
)
def snapshot_guard(spark, sf_dir):
    return h.snapshot_guard(facts(spark, sf_dir))


@plan(
    "a9_guarded_snapshot",
    """SELECT account_ref, ticker, shares, round(shares * close, 4) AS market_value FROM chosen_facts
       WHERE account_ref IN (SELECT account_ref FROM chosen_facts GROUP BY 1 HAVING count(*) FILTER (WHERE shares <= 0 OR close IS NULL) = 0 AND count(DISTINCT price_as_of) = 1)""",
    uses=("chosen_facts",),
)
def guarded_snapshot(spark, sf_dir):
    """Snapshots of the accounts that pass the guard, written by date and read back; the others write nothing.

    Every second account is left as it is, the others keep complete rows, half of them those of one date.
    """
    rows = staged(facts(spark, sf_dir), "facts")
    number = F.substring("account_ref", 2, 9).cast("long")
    complete = F.col("close").isNotNull() & (F.col("shares") > 0)
    latest = rows.agg(F.max("price_as_of").alias("d")).scalar()
    rows = rows.filter((number % 2 == 1) | (complete & ((number % 4 == 2) | (F.col("price_as_of") == latest))))
    rows = h.snapshot_rows(rows)
    path = scratch_path(spark, "guarded-snapshots")
    writers.upsert_slices(rows, path, "snapshot_date")
    return spark.read.schema(rows.schema).parquet(path).select(
        "account_ref", "ticker", "shares", F.round("market_value", 4).alias("market_value")
    )


@plan(
    "e13_distinct_price_date_guard",
    """SELECT account_ref, min(price_as_of) AS first_date, max(price_as_of) AS last_date,
              min(price_as_of) = max(price_as_of) AS one_date FROM facts GROUP BY 1""",
    uses=("facts",),
)
def price_date_guard(spark, sf_dir):
    return h.price_date_guard(facts(spark, sf_dir))


@plan(
    "e1_portfolio_value_by_date",
    """SELECT account_ref, snapshot_date, round(sum(market_value), 4) AS total_value FROM fx_snapshots GROUP BY 1, 2""",
    uses=("fx_snapshots",),
)
def value_by_date(spark, sf_dir):
    return rounded(h.value_by_date(fx_snapshots(spark, sf_dir)), 4)


@plan(
    "e2_composition_constant",
    """SELECT account_ref, count(*) AS dates, count(DISTINCT c) = 1 AS constant FROM (
         SELECT account_ref, snapshot_date, CAST(list_sort(list(ticker || ':' || shares)) AS VARCHAR) AS c
         FROM fx_snapshots GROUP BY 1, 2) GROUP BY 1""",
    uses=("fx_snapshots",),
)
def composition_constant(spark, sf_dir):
    return h.composition_constant(fx_snapshots(spark, sf_dir))


@plan(
    "f18_snapshot_drawdown",
    """SELECT account_ref, dates, CASE WHEN kinds > 1 THEN 'COMPOSITION_CHANGED' WHEN dates < 2 THEN 'TOO_FEW_DATES' ELSE 'OK' END AS status,
              CASE WHEN kinds = 1 AND dates >= 2 THEN round(cur, 6) END AS current_drawdown_pct,
              CASE WHEN kinds = 1 AND dates >= 2 THEN round(mx, 6) END AS max_drawdown_pct
       FROM (SELECT account_ref, count(*) AS dates, count(DISTINCT shares) AS kinds,
                    arg_max(dd, snapshot_date) * 100 AS cur, min(dd) * 100 AS mx
             FROM (SELECT *, market_value / max(market_value) OVER (PARTITION BY account_ref ORDER BY snapshot_date) - 1 AS dd
                   FROM fx_snapshots) GROUP BY 1)""",
    uses=("fx_snapshots",),
)
def snapshot_drawdown(spark, sf_dir):
    return rounded(h.snapshot_drawdown(fx_snapshots(spark, sf_dir)))


@plan(
    "h2_replace_slice_union",
    """SELECT account_ref, snapshot_date, ticker, round(shares, 6) AS shares, round(market_value, 4) AS market_value FROM (
         SELECT * FROM fx_snapshots WHERE snapshot_date < '2000-01-01'
         UNION ALL SELECT account_ref, snapshot_date, ticker, shares, market_value * 2 FROM fx_snapshots
                   WHERE snapshot_date >= '2000-01-01')""",
    uses=("fx_snapshots",),
)
def replace_slice(spark, sf_dir):
    old = fx_snapshots(spark, sf_dir)
    new = old.filter(F.col("snapshot_date") >= "2000-01-01").withColumn(
        "market_value", F.col("market_value") * 2
    )
    out = h.replace_slice(old, new, ["snapshot_date"])
    return rounded(out.withColumn("market_value", F.round("market_value", 4)))


@plan(
    "e10_ticker_set_union_distinct",
    """SELECT DISTINCT upper(trim(ticker)) AS ticker FROM (SELECT ticker FROM fx_holdings
         UNION ALL SELECT ticker FROM fx_universe_raw UNION ALL SELECT ticker FROM fx_benchmarks)""",
    uses=("fx_holdings", "fx_universe_raw", "fx_benchmarks"),
)
def ticker_union(spark, sf_dir):
    return h.ticker_union(
        fx_holdings(spark, sf_dir), fx_universe_raw(spark, sf_dir), fx_benchmarks(spark, sf_dir)
    )
