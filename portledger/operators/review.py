"""Review of candidates and rules on mature outcomes: scores, gates, episodes, promotion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.operators.scans import DAY, Order, drop_chunks, running, with_chunks

# The weights of the six selection dimensions, in per cent.
DIMENSIONS = {
    "quality": 25,
    "growth": 20,
    "valuation": 20,
    "trend": 15,
    "catalyst": 10,
    "risk_control": 10,
}


def selection_score(df: DataFrame, *, renormalise: bool = True) -> DataFrame:
    """Weighted 0-100 score and coverage; a missing dimension lowers coverage only."""
    present = sum(F.when(F.col(d).isNotNull(), w).otherwise(0) for d, w in DIMENSIONS.items())
    points = sum(F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in DIMENSIONS.items())
    base = F.when(F.col("coverage_pct") > 0, F.col("coverage_pct")) if renormalise else F.lit(100)
    return df.withColumn("coverage_pct", present.cast("double")).withColumn(
        "selection_score", F.when(F.col("coverage_pct") > 0, points / base)
    )


def state_eligibility(reviews: DataFrame, **limits) -> DataFrame:
    """State each review supports; two reviews in a row open or remove a candidate."""
    order = Order(("ticker",), "seq", "seq", width=1 << 16)
    passing = (F.col("selection_score") >= 70) & (F.col("coverage_pct") >= 85) & F.col("gates_ok")
    failing = F.col("selection_score") < 60
    flags = reviews.withColumn("_pass", F.coalesce(passing, F.lit(False))).withColumn(
        "_fail", F.coalesce(failing, F.lit(False))
    )
    rows = drop_chunks(
        running(
            with_chunks(flags, order, **limits), order,
            {"_before": ("last", F.struct("_pass", "_fail"), False)},
        )
    )
    before = F.col("_before")
    twice = F.col("_pass") & F.coalesce(before["_pass"], F.lit(False))
    out = F.col("_fail") & F.coalesce(before["_fail"], F.lit(False))
    score, coverage = F.col("selection_score"), F.col("coverage_pct")
    state = (
        F.when(out, "REMOVED")
        .when(twice, "OPEN_CANDIDATE")
        .when(score >= 70, "NEAR_TRIGGER")
        .when((coverage >= 70) & (score >= 60) & F.col("gates_ok"), "WATCHING")
        .otherwise("RESEARCH_QUEUE")
    )
    return rows.withColumn("eligible_state", state).drop("_pass", "_fail", "_before")


def hard_gates(df: DataFrame) -> DataFrame:
    """Adds the reasons a candidate is barred."""
    rules = [
        ("MARKET_CAP_BELOW_2BN", F.col("market_cap") < 2e9),
        ("TRADED_VALUE_BELOW_20M", F.col("traded_value_20d") < 2e7),
        ("PRICE_BELOW_5", F.col("price") < 5),
        ("COVERAGE_BELOW_70", F.col("coverage_pct") < 70),
        ("EARNINGS_WITHIN_3_DAYS", F.col("days_to_earnings").between(0, 3)),
    ]
    reasons = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in rules]), lambda r: r.isNotNull())
    return df.withColumn("gate_reasons", reasons)


def group_review(outcomes: DataFrame, *dims: str) -> DataFrame:
    """Mature outcomes by every prefix of ``dims``: counts, coverage, returns and the worst case."""
    mature = F.col("status").startswith("MATURED")
    return outcomes.rollup(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(mature).alias("mature"),
        (F.count("actual_return_pct") / F.count(F.lit(1)) * 100.0).alias("coverage_pct"),
        F.avg("hold_return_pct").alias("avg_hold_pct"),
        F.avg("advice_return_pct").alias("avg_advice_pct"),
        F.avg("actual_return_pct").alias("avg_actual_pct"),
        F.min("hold_return_pct").alias("worst_hold_pct"),
        F.grouping_id().alias("level"),
    )


def episodes(signals: DataFrame, **limits) -> DataFrame:
    """Adds ``episode_no``: it grows only when thesis, factors or evidence change."""
    order = Order(("ticker",), "pos", "seq")
    idea = F.struct("thesis", "factors", "evidence")
    chunked = with_chunks(signals, order, **limits)
    seen = running(chunked, order, {"_before": ("last", idea, False)})
    changed = ~F.col("_before").eqNullSafe(idea)
    rows = running(
        seen.withColumn("_new", F.when(changed, 1).otherwise(0).cast("long")), order,
        {"episode_no": ("sum", F.col("_new"), True)},
    )
    return drop_chunks(rows).drop("_before", "_new")


def latest_before(
    queries: DataFrame, cases: DataFrame, keys: tuple[str, ...], k: int, **limits
) -> DataFrame:
    """Per query the last ``k`` cases of the same keys that matured before its cutoff.

    Cases are numbered along time by a chunked scan that queries take part in,
    so each query knows how many came before it; the cases themselves follow by
    an equi-join on (keys, number).
    """
    timeline = cases.select(
        *keys, F.unix_micros("matured_at").alias("pos"), F.lit(1).cast("long").alias("is_case"),
        F.col("case_id").alias("id"),
    ).unionByName(
        # At equal times the query comes first: maturity must be strictly earlier.
        queries.select(
            *keys, F.unix_micros("cutoff").alias("pos"), F.lit(0).cast("long").alias("is_case"),
            F.col("query_id").alias("id"),
        )
    )
    order = Order(keys, "pos", "is_case", width=DAY, rest=("id",))
    counted = running(
        with_chunks(timeline, order, **limits), order, {"case_no": ("sum", F.col("is_case"), True)}
    )
    numbered = counted.filter(F.col("is_case") == 1).select(*keys, "case_no", F.col("id").alias("case_id"))
    last = F.col("case_no")
    wanted = counted.filter((F.col("is_case") == 0) & (last > 0)).select(
        *keys, F.col("id").alias("query_id"),
        F.explode(F.sequence(F.greatest(last - (k - 1), F.lit(1).cast("long")), last)).alias("case_no"),
    )
    return wanted.join(numbered, [*keys, "case_no"]).select("query_id", "case_id")


def similar_cases(queries: DataFrame, cases: DataFrame, k: int = 3, **limits) -> DataFrame:
    """The ``k`` best earlier mature cases per query: action and factor, then regime, then ticker.

    The last ``k`` of each tier contain the best ``k`` overall, so a query never
    meets more than ``3k`` cases.
    """
    tiers = (("ticker", "action", "factor"), ("ticker", "regime"), ("ticker",))
    found = None
    for tier, keys in enumerate(tiers):
        part = latest_before(queries, cases, keys, k, **limits).withColumn("tier", F.lit(tier))
        found = part if found is None else found.unionByName(part)
    best_tier = found.groupBy("query_id", "case_id").agg(F.min("tier").alias("tier"))
    facts = cases.select("case_id", "matured_at", "outcome_pct")
    best = Window.partitionBy("query_id").orderBy("tier", F.desc("matured_at"), F.desc("case_id"))
    return best_tier.join(facts, "case_id").withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= k
    ).select("query_id", "case_id", "tier", "rank", "outcome_pct")


def walk_forward(samples: DataFrame, split_at: Column) -> DataFrame:
    """Train and holdout statistics of a rule against its baseline, split by time, never at random."""
    part = F.when(F.col("at") < split_at, "TRAIN").otherwise("HOLDOUT")
    edge = F.col("rule_return_pct") - F.col("base_return_pct")

    def downside(c: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.least(F.col(c), F.lit(0.0)), 2)))

    return samples.withColumn("part", part).groupBy("rule_id", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("episode").alias("episodes"),
        F.count_distinct("regime").alias("regimes"),
        F.avg("rule_return_pct").alias("rule_mean"),
        F.avg("base_return_pct").alias("base_mean"),
        F.avg(edge).alias("edge"),
        F.min("rule_drawdown_pct").alias("rule_drawdown"),
        F.min("base_drawdown_pct").alias("base_drawdown"),
        downside("rule_return_pct").alias("rule_downside"),
        downside("base_return_pct").alias("base_downside"),
        F.min("rule_return_pct").alias("rule_worst"),
        F.min("base_return_pct").alias("base_worst"),
    )


@dataclass(frozen=True)
class PromotionRules:
    min_episodes: int = 20
    min_regimes: int = 2


def promotion_gate(stats: DataFrame, rules: PromotionRules = PromotionRules()) -> DataFrame:
    """Decision per rule; the last step, approval, stays with the user."""
    by_rule = stats.groupBy("rule_id").agg(
        F.sum("episodes").alias("episodes"),
        F.max("regimes").alias("regimes"),
        F.max(F.when(F.col("part") == "HOLDOUT", F.struct("edge", "rule_drawdown", "base_drawdown", "rule_downside", "base_downside", "rule_worst", "base_worst"))).alias("h"),
        F.max(F.when(F.col("part") == "TRAIN", F.col("edge"))).alias("train_edge"),
    )
    h = F.col("h")
    worse = (h["edge"] < 0) | (h["rule_drawdown"] < h["base_drawdown"])
    stable = (
        (F.col("train_edge") > 0) & (h["edge"] > 0)
        & (h["rule_downside"] <= h["base_downside"]) & (h["rule_worst"] >= h["base_worst"])
    )
    thin = (F.col("episodes") < rules.min_episodes) | (F.col("regimes") < rules.min_regimes) | h.isNull()
    return by_rule.select(
        "rule_id", "episodes", "regimes",
        F.when(thin, "INSUFFICIENT_EVIDENCE").when(worse, "REJECT")
        .when(stable, "ELIGIBLE_FOR_USER_APPROVAL").otherwise("KEEP_CANDIDATE").alias("decision"),
    )


def candidate_outcomes(
    entries: DataFrame, closes: DataFrame, calendar: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)
) -> DataFrame:
    """Return against the benchmark, worst fall and worst day after each state entry.

    ``closes(ticker, session_date, close, bench_close)`` has one row per ticker
    and session: the windows ahead are bounded by the calendar, computed once
    per session, and an entry joins one row.
    """
    number = F.broadcast(calendar.select("session_date", "session_idx"))
    days = closes.join(number, "session_date")
    w = Window.partitionBy("ticker").orderBy("session_idx")
    step = F.col("close") / F.lag("close").over(w) - 1.0
    days = days.withColumn("step", step)
    # The longest path ahead holds all others: it is collected once and walked once for all horizons.
    ahead = F.struct("session_idx", "close", "bench_close", "step")
    path = F.sort_array(F.collect_list(ahead).over(w.rangeBetween(1, max(horizons))))
    none = F.lit(None).cast("double")

    def walked(a: Column, d: Column) -> Column:
        peak, gap = F.greatest(a["peak"], d["close"]), d["session_idx"] - F.col("session_idx")
        fall, parts = d["close"] / peak - 1.0, [peak.alias("peak")]
        for k in horizons:
            inside, last = gap <= k, gap == k
            parts += [
                F.when(inside, F.least(a[f"fall_{k}"], fall)).otherwise(a[f"fall_{k}"]).alias(f"fall_{k}"),
                F.when(inside, F.least(a[f"step_{k}"], d["step"])).otherwise(a[f"step_{k}"]).alias(f"step_{k}"),
                F.when(last, d["close"]).otherwise(a[f"end_{k}"]).alias(f"end_{k}"),
                F.when(last, d["bench_close"]).otherwise(a[f"bench_{k}"]).alias(f"bench_{k}"),
            ]
        return F.struct(*parts)

    start = [F.col("close").cast("double").alias("peak")]
    for k in horizons:
        start += [F.lit(0.0).alias(f"fall_{k}"), *[none.alias(f"{c}_{k}") for c in ("step", "end", "bench")]]
    days = days.withColumn("_path", path).withColumn("_w", F.aggregate("_path", F.struct(*start), walked))
    for k in horizons:
        end, bench, fall, worst = (F.col(f"_w.{c}_{k}") for c in ("end", "bench", "fall", "step"))
        days = days.withColumns({
            f"ret_{k}": (end / F.col("close") - 1.0) * 100.0,
            f"rel_{k}": (end / F.col("close") - 1.0) * 100.0 - (bench / F.col("bench_close") - 1.0) * 100.0,
            f"drawdown_{k}": fall * 100.0, f"worst_day_{k}": worst * 100.0,
        })
    measures = [f"{m}_{k}" for k in horizons for m in ("ret", "rel", "drawdown", "worst_day")]
    return entries.join(days.select("ticker", "session_date", *measures), ["ticker", "session_date"], "left")
