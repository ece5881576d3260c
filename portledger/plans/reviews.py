"""Plans that review candidates, episodes, similar cases and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from portledger.operators import review as r
from portledger.plans.fixtures import fx_bars, fx_calendar, fx_market, table
from portledger.plans.registry import plan, rounded
from portledger.sources.staging import staged


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def reviews(spark, sf_dir):
    i = F.col("event_id")

    def part(factor: int, gap: int):
        return F.when(i % gap != 0, (50 + i * factor % 51).cast("double"))

    return events(spark, sf_dir).select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("ticker"), i.alias("seq"),
        part(7, 101).alias("quality"), part(11, 5).alias("growth"), part(13, 7).alias("valuation"),
        part(17, 11).alias("trend"), part(19, 13).alias("catalyst"), part(23, 17).alias("risk_control"),
        (i % 9 != 0).alias("gates_ok"),
    )


REVIEW_SQL = """SELECT seq, ticker, ok, cov, CASE WHEN cov > 0 THEN pts / cov END AS score FROM (
  SELECT event_id AS seq, 'U' || (user_id % 50) AS ticker, event_id % 9 <> 0 AS ok,
    CAST((CASE WHEN event_id % 101 <> 0 THEN 25 ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 20 ELSE 0 END + CASE WHEN event_id % 7 <> 0 THEN 20 ELSE 0 END
     + CASE WHEN event_id % 11 <> 0 THEN 15 ELSE 0 END + CASE WHEN event_id % 13 <> 0 THEN 10 ELSE 0 END + CASE WHEN event_id % 17 <> 0 THEN 10 ELSE 0 END) AS DOUBLE) AS cov,
    CASE WHEN event_id % 101 <> 0 THEN 25 * (50 + event_id * 7 % 51) ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 20 * (50 + event_id * 11 % 51) ELSE 0 END
     + CASE WHEN event_id % 7 <> 0 THEN 20 * (50 + event_id * 13 % 51) ELSE 0 END + CASE WHEN event_id % 11 <> 0 THEN 15 * (50 + event_id * 17 % 51) ELSE 0 END
     + CASE WHEN event_id % 13 <> 0 THEN 10 * (50 + event_id * 19 % 51) ELSE 0 END + CASE WHEN event_id % 17 <> 0 THEN 10 * (50 + event_id * 23 % 51) ELSE 0 END AS pts
  FROM events)"""


@plan(
    "l1_selection_score",
    f"SELECT seq, ticker, cov AS coverage_pct, round(score, 6) AS selection_score FROM ({REVIEW_SQL})",
)
def selection_score(spark, sf_dir):
    out = r.selection_score(reviews(spark, sf_dir))
    return rounded(out.select("seq", "ticker", "coverage_pct", "selection_score"))


@plan(
    "l2_candidate_state_eligibility",
    f"""SELECT seq, CASE WHEN fail AND coalesce(lag(fail) OVER w, false) THEN 'REMOVED' WHEN pass AND coalesce(lag(pass) OVER w, false) THEN 'OPEN_CANDIDATE'
               WHEN score >= 70 THEN 'NEAR_TRIGGER' WHEN cov >= 70 AND score >= 60 AND ok THEN 'WATCHING' ELSE 'RESEARCH_QUEUE' END AS eligible_state
        FROM (SELECT *, coalesce(score >= 70 AND cov >= 85 AND ok, false) AS pass, coalesce(score < 60, false) AS fail FROM ({REVIEW_SQL}))
        WINDOW w AS (PARTITION BY ticker ORDER BY seq)""",
)
def state_eligibility(spark, sf_dir):
    out = r.state_eligibility(r.selection_score(reviews(spark, sf_dir)))
    return out.select("seq", "eligible_state")


@plan(
    "l3_candidate_hard_gates",
    """SELECT o_orderkey AS seq, array_to_string(list_filter([CASE WHEN o_totalprice * 10000 < 2e9 THEN 'MARKET_CAP_BELOW_2BN' END,
         CASE WHEN o_totalprice * 100 < 2e7 THEN 'TRADED_VALUE_BELOW_20M' END, CASE WHEN o_custkey % 20 < 5 THEN 'PRICE_BELOW_5' END,
         CASE WHEN 100 - o_orderkey % 50 < 70 THEN 'COVERAGE_BELOW_70' END, CASE WHEN o_orderkey % 9 <= 3 THEN 'EARNINGS_WITHIN_3_DAYS' END], lambda x: x IS NOT NULL), ',') AS reasons
       FROM orders""",
)
def hard_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") * 10000).alias("market_cap"),
        (F.col("o_totalprice") * 100).alias("traded_value_20d"), (F.col("o_custkey") % 20).alias("price"),
        (100 - F.col("o_orderkey") % 50).alias("coverage_pct"), (F.col("o_orderkey") % 9).alias("days_to_earnings"),
    )
    return r.hard_gates(rows).select("seq", F.concat_ws(",", "gate_reasons").alias("reasons"))


@plan(
    "l4_outcome_group_review",
    """SELECT l_linestatus AS regime, l_returnflag AS action, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE l_linenumber % 5 <> 0) AS mature,
              round(count(CASE WHEN l_linenumber % 5 <> 0 THEN 1 END) / count(*) * 100, 6) AS coverage_pct, round(avg(l_discount * 100 - 5), 6) AS avg_hold_pct,
              round(avg(l_tax * 100 - 4), 6) AS avg_advice_pct, round(avg(CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity - 25 END), 6) AS avg_actual_pct,
              round(min(l_discount * 100 - 5), 6) AS worst_hold_pct, CAST(grouping(l_linestatus, l_returnflag) AS BIGINT) AS level
       FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)""",
)
def group_review(spark, sf_dir):
    mature = F.col("l_linenumber") % 5 != 0
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("regime"), F.col("l_returnflag").alias("action"),
        F.when(mature, "MATURED").otherwise("PENDING").alias("status"),
        (F.col("l_discount") * 100 - 5).alias("hold_return_pct"), (F.col("l_tax") * 100 - 4).alias("advice_return_pct"),
        F.when(mature, F.col("l_quantity") - 25).alias("actual_return_pct"),
    )
    return rounded(r.group_review(rows, "regime", "action"))


@plan(
    "l5_episode_dedup",
    """SELECT ticker, count(*) AS signals, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS episodes FROM (
         SELECT ticker, coalesce(idea = lag(idea) OVER (PARTITION BY ticker ORDER BY ts, event_id), false) AS same
         FROM (SELECT ts, event_id, 'U' || (user_id % 50) AS ticker, event_type || '|' || (event_id % 2) AS idea FROM events)) GROUP BY 1""",
)
def episode_dedup(spark, sf_dir):
    signals = events(spark, sf_dir).select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("ticker"),
        F.unix_micros("ts").alias("pos"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("thesis"), (F.col("event_id") % 2).cast("string").alias("factors"), F.lit("same").alias("evidence"),
    )
    # The key is (ticker); pos is the time and seq breaks ties.
    out = r.episodes(signals)
    return out.groupBy("ticker").agg(F.count(F.lit(1)).alias("signals"), F.max("episode_no").alias("episodes"))


@plan(
    "l6_similar_case_recall",
    """SELECT query_id, case_id, CAST(tier AS INT) AS tier, CAST(rank AS INT) AS rank, outcome_pct FROM (
         SELECT q.event_id AS query_id, c.event_id AS case_id, c.value AS outcome_pct,
                CASE WHEN q.event_id % 3 = c.event_id % 3 AND q.event_id % 4 = c.event_id % 4 THEN 0 WHEN q.event_id % 2 = c.event_id % 2 THEN 1 ELSE 2 END AS tier,
                row_number() OVER (PARTITION BY q.event_id ORDER BY CASE WHEN q.event_id % 3 = c.event_id % 3 AND q.event_id % 4 = c.event_id % 4 THEN 0
                    WHEN q.event_id % 2 = c.event_id % 2 THEN 1 ELSE 2 END, c.ts DESC, c.event_id DESC) AS rank
         FROM events q JOIN events c ON q.user_id % 10 = c.user_id % 10 AND c.ts < q.ts
         WHERE q.event_type = 'purchase' AND c.event_type = 'view') WHERE rank <= 3""",
)
def similar_cases(spark, sf_dir):
    i = F.col("event_id")
    kinds = [
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("ticker"),
        (i % 3).alias("action"), (i % 4).alias("factor"), (i % 2).alias("regime"),
    ]
    base = events(spark, sf_dir)
    queries = base.filter(F.col("event_type") == "purchase").select(i.alias("query_id"), F.col("ts").alias("cutoff"), *kinds)
    cases = base.filter(F.col("event_type") == "view").select(
        i.alias("case_id"), F.col("ts").alias("matured_at"), F.col("value").alias("outcome_pct"), *kinds
    )
    return r.similar_cases(staged(queries, "queries"), staged(cases, "cases"))


@plan(
    "l7_candidate_outcomes",
    """SELECT ticker, CAST(session_date AS VARCHAR) AS session_date, """
    + ", ".join(
        f"""round((max(CASE WHEN d = {k} THEN close END) / any_value(c0) - 1) * 100, 6) AS ret_{k},
            round((max(CASE WHEN d = {k} THEN close END) / any_value(c0) - 1) * 100 - (max(CASE WHEN d = {k} THEN bench END) / any_value(b0) - 1) * 100, 6) AS rel_{k},
            round(min(CASE WHEN d <= {k} THEN step END) * 100, 6) AS worst_day_{k},
            round(least(coalesce(min(CASE WHEN d <= {k} THEN close / peak - 1 END), 0), 0) * 100, 6) AS drawdown_{k}"""
        for k in (1, 5, 20)
    )
    + """ FROM (SELECT a.ticker, a.session_date, a.close AS c0, a.bench AS b0, b.session_idx - a.session_idx AS d, b.close, b.bench, b.step,
                      greatest(a.close, max(b.close) OVER (PARTITION BY a.ticker, a.session_idx ORDER BY b.session_idx)) AS peak
               FROM seq a LEFT JOIN seq b ON a.ticker = b.ticker AND b.session_idx BETWEEN a.session_idx + 1 AND a.session_idx + 20) p
       GROUP BY ticker, session_date""",
    uses=("seq",),
)
def candidate_outcomes(spark, sf_dir):
    """Every session of every ticker as an entry, at all three horizons."""
    bench = fx_market(spark, sf_dir).select("session_date", F.col("close").alias("bench_close"))
    closes = fx_bars(spark, sf_dir).select("ticker", "session_date", "close").join(F.broadcast(bench), "session_date")
    closes = staged(closes, "closes")
    entries = closes.select("ticker", "session_date")
    out = r.candidate_outcomes(entries, closes, fx_calendar(spark, sf_dir))
    return rounded(out.withColumn("session_date", F.col("session_date").cast("string")))


def samples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string")).alias("rule_id"), F.col("l_shipdate").alias("at"),
        F.col("l_orderkey").alias("episode"), F.col("l_returnflag").alias("regime"),
        (F.col("l_discount") * 100 - 4).alias("rule_return_pct"), (F.col("l_tax") * 100 - 4).alias("base_return_pct"),
        (-F.col("l_quantity") + F.col("l_suppkey") % 7).alias("rule_drawdown_pct"), (-F.col("l_quantity") + 2).alias("base_drawdown_pct"),
    )


WALK_SQL = """SELECT 'R' || (l_suppkey % 7) AS rule_id, CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'TRAIN' ELSE 'HOLDOUT' END AS part,
  count(*) AS n, count(DISTINCT l_orderkey) AS episodes, count(DISTINCT l_returnflag) AS regimes, avg(l_discount * 100 - 4) AS rule_mean, avg(l_tax * 100 - 4) AS base_mean,
  avg((l_discount * 100 - 4) - (l_tax * 100 - 4)) AS edge, min(-l_quantity + l_suppkey % 7) AS rule_drawdown, min(-l_quantity + 2) AS base_drawdown,
  sqrt(avg(pow(least(l_discount * 100 - 4, 0), 2))) AS rule_downside, sqrt(avg(pow(least(l_tax * 100 - 4, 0), 2))) AS base_downside,
  min(l_discount * 100 - 4) AS rule_worst, min(l_tax * 100 - 4) AS base_worst FROM lineitem GROUP BY 1, 2"""


def _walk(spark, sf_dir):
    return r.walk_forward(samples(spark, sf_dir), F.lit("2000-01-01").cast("timestamp_ntz"))


@plan(
    "l8_rule_walk_forward",
    f"""SELECT rule_id, part, n, episodes, regimes, {', '.join(f'round({c}, 6) AS {c}' for c in ('rule_mean', 'base_mean', 'edge', 'rule_drawdown', 'base_drawdown', 'rule_downside', 'base_downside', 'rule_worst', 'base_worst'))} FROM ({WALK_SQL})""",
)
def walk_forward(spark, sf_dir):
    return rounded(_walk(spark, sf_dir))


@plan(
    "l9_promotion_gate",
    f"""SELECT rule_id, CAST(episodes AS BIGINT) AS episodes, regimes, CASE WHEN episodes < 20 OR regimes < 2 OR h_edge IS NULL THEN 'INSUFFICIENT_EVIDENCE'
              WHEN h_edge < 0 OR h_rd < h_bd THEN 'REJECT' WHEN t_edge > 0 AND h_edge > 0 AND h_rs <= h_bs AND h_rw >= h_bw THEN 'ELIGIBLE_FOR_USER_APPROVAL' ELSE 'KEEP_CANDIDATE' END AS decision
        FROM (SELECT rule_id, sum(episodes) AS episodes, max(regimes) AS regimes, max(CASE WHEN part = 'HOLDOUT' THEN edge END) AS h_edge, max(CASE WHEN part = 'TRAIN' THEN edge END) AS t_edge,
                     max(CASE WHEN part = 'HOLDOUT' THEN rule_drawdown END) AS h_rd, max(CASE WHEN part = 'HOLDOUT' THEN base_drawdown END) AS h_bd,
                     max(CASE WHEN part = 'HOLDOUT' THEN rule_downside END) AS h_rs, max(CASE WHEN part = 'HOLDOUT' THEN base_downside END) AS h_bs,
                     max(CASE WHEN part = 'HOLDOUT' THEN rule_worst END) AS h_rw, max(CASE WHEN part = 'HOLDOUT' THEN base_worst END) AS h_bw FROM ({WALK_SQL}) GROUP BY 1)""",
)
def promotion_gate(spark, sf_dir):
    return r.promotion_gate(_walk(spark, sf_dir))
