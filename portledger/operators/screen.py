"""Candidate scoring, risk tags, discovery ranking and watchlist rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.functions.columns import clean_text, clean_ticker, safe_float, text
from portledger.operators.market import BENCHMARKS, technical_state

NO_SCORE = -99
SEVERE_RISKS = ("RSI_HOT", "VOL_30D_HIGH", "BELOW_SMA_50", "WEAKER_THAN_SPY_20D")

# The universe used when none is configured.
DEFAULT_UNIVERSE = (
    ("MSFT", "Microsoft", "AI software / cloud"),
    ("NVDA", "NVIDIA", "AI accelerators"),
    ("AVGO", "Broadcom", "AI networking / custom silicon"),
    ("AMZN", "Amazon", "cloud / consumer"),
    ("GOOGL", "Alphabet", "search / cloud / AI"),
    ("META", "Meta Platforms", "AI advertising"),
    ("TSM", "Taiwan Semiconductor", "advanced foundry"),
    ("ASML", "ASML", "semiconductor equipment"),
    ("AMD", "Advanced Micro Devices", "AI accelerators"),
    ("ANET", "Arista Networks", "AI networking"),
    ("PANW", "Palo Alto Networks", "cybersecurity"),
    ("CRWD", "CrowdStrike", "cybersecurity"),
    ("NOW", "ServiceNow", "enterprise software"),
    ("PLTR", "Palantir", "AI software"),
    ("ARM", "Arm Holdings", "compute IP"),
)


def load_universe(raw: DataFrame) -> DataFrame:
    """Clean tickers, first row per ticker by ``seq``; the default list when empty.

    The first row is a grouped minimum, so copies of one ticker collapse before
    the shuffle.
    """
    spark = raw.sparkSession
    default = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(DEFAULT_UNIVERSE)],
        "seq long, ticker string, company_name string, theme string",
    )
    kept = raw.withColumn("ticker", clean_ticker(F.col("ticker"))).filter(F.col("ticker") != "")
    first = (
        kept.groupBy("ticker")
        .agg(F.min_by(F.struct("seq", "company_name", "theme"), "seq").alias("_f"))
        .select("ticker", "_f.*")
    )
    empty = raw.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return first.unionByName(default.filter(empty))


def score_terms() -> list[tuple[str, int, Column]]:
    c = F.col
    return [
        ("ABOVE_SMA_50", 1, c("sma_50_gap_pct") > 0),
        ("ABOVE_SMA_200", 1, c("sma_200_gap_pct") > 0),
        ("RET_60D_POSITIVE", 1, c("ret_60d_pct") > 0),
        ("STRONGER_THAN_SPY_20D", 1, c("rel_spy_20d_pct") > 0),
        ("RSI_NOT_HOT", 1, c("rsi_14").between(45, 70)),
        ("VOL_NOT_EXTREME", 1, c("vol_30d_ann_pct") <= 75),
        ("DRAWDOWN_NOT_EXTREME", 1, c("max_drawdown_1y_pct") > -45),
        ("RSI_HOT_PENALTY", -2, c("rsi_14") > 78),
        ("FAR_BELOW_SMA_200", -2, c("sma_200_gap_pct") < -8),
    ]


def candidate_score(metrics: DataFrame) -> DataFrame:
    """Adds ``state``, ``score`` (-99 without data) and the ordered ``reasons``."""
    terms = score_terms()
    points = sum(F.when(test, weight).otherwise(0) for _, weight, test in terms)
    reasons = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, _, test in terms]), lambda r: r.isNotNull()
    )
    lacking = F.col("state") == "INSUFFICIENT_DATA"
    return (
        metrics.withColumn("state", technical_state())
        .withColumn("score", F.when(lacking, NO_SCORE).otherwise(points))
        .withColumn(
            "reasons", F.when(lacking, F.array(F.lit("INSUFFICIENT_HISTORY"))).otherwise(reasons)
        )
    )


def risk_tags() -> Column:
    c = F.col
    rules = [
        ("RSI_HOT", c("rsi_14") >= 75),
        ("VOL_30D_HIGH", c("vol_30d_ann_pct") > 90),
        ("DEEP_DRAWDOWN_1Y", c("max_drawdown_1y_pct") <= -50),
        ("NEAR_1Y_HIGH", c("current_drawdown_1y_pct") > -2),
        ("BELOW_SMA_50", c("sma_50_gap_pct") < 0),
        ("WEAKER_THAN_SPY_20D", c("rel_spy_20d_pct") < 0),
    ]
    found = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda r: r.isNotNull()
    )
    return F.when(c("close").isNull(), F.array(F.lit("NO_PRICE"))).otherwise(found)


def opening_risks(metrics: DataFrame) -> DataFrame:
    return candidate_score(metrics).withColumn("risks", risk_tags())


def exclude_severe(scored: DataFrame, min_score: int = 5) -> DataFrame:
    severe = F.array(*[F.lit(r) for r in SEVERE_RISKS])
    return scored.filter((F.col("score") >= min_score) & ~F.arrays_overlap("risks", severe))


def unheld(universe: DataFrame, held: DataFrame) -> DataFrame:
    """Universe without held tickers and benchmarks; Spark picks the anti-join by size."""
    free = universe.filter(~F.col("ticker").isin(*BENCHMARKS))
    return free.join(held.select("ticker").distinct(), "ticker", "left_anti")


def priced(universe: DataFrame, metrics: DataFrame) -> DataFrame:
    return universe.join(metrics.filter(F.col("close").isNotNull()), "ticker", "left_semi")


def rank_keys() -> list[Column]:
    """Score, then relative and plain 20-day return as shown (one decimal), then list order."""
    shown = [F.coalesce(F.round(c, 1), F.lit(-99.0)) for c in ("rel_spy_20d_pct", "ret_20d_pct")]
    return [F.desc("score"), *[s.desc() for s in shown], F.asc("seq")]


def top_discoveries(scored: DataFrame, limit: int = 3) -> DataFrame:
    """Global top list; Spark plans it as take-ordered, never a full sort."""
    return scored.orderBy(*rank_keys()).limit(max(limit, 0))


def top_discoveries_by(scored: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Top list per group; Spark filters ranks per partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*rank_keys())
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= max(limit, 0))


def opening_candidates(
    universe: DataFrame, metrics: DataFrame, held: DataFrame, limit: int = 3
) -> DataFrame:
    pool = unheld(universe, held).join(metrics.filter(F.col("close").isNotNull()), "ticker")
    best = top_discoveries(exclude_severe(opening_risks(pool)), limit)
    return best.select(
        "ticker",
        clean_text(F.col("company_name"), "").alias("company_name"),
        clean_text(F.col("theme"), "UNCONFIRMED").alias("theme"),
        "close", "price_as_of", "ret_20d_pct", "ret_60d_pct", "rel_spy_20d_pct", "rsi_14", "score",
        F.concat_ws("; ", F.slice("reasons", 1, 3)).alias("reason_text"),
        F.when(F.size("risks") > 0, F.concat_ws("; ", F.slice("risks", 1, 3)))
        .otherwise("UNVERIFIED_NEWS_EARNINGS_VALUATION")
        .alias("risk_text"),
    )


def persistent_candidates(watchlist: DataFrame, metrics: DataFrame) -> DataFrame:
    """Watchlist rows with price facts, technical pre-screen and the two first risks."""
    listed = watchlist.withColumn("ticker", clean_ticker(F.col("ticker"))).filter(
        F.col("ticker") != ""
    )
    listed = listed.withColumnRenamed("state", "funnel_state")
    scored = opening_risks(listed.join(metrics, "ticker", "left"))
    full = safe_float(F.col("selection_score"), -1.0)
    coverage = safe_float(F.col("coverage_pct"), -1.0)
    return scored.select(
        "ticker",
        clean_text(F.col("funnel_state"), "RESEARCH_QUEUE").alias("funnel_state"),
        F.when(full >= 0, full).alias("selection_score"),
        F.when(coverage >= 0, coverage).alias("coverage_pct"),
        "close", "price_as_of", "ret_1d_pct", "ret_20d_pct", "rel_spy_20d_pct",
        F.when(F.col("score") >= 0, F.concat(F.col("score").cast("string"), F.lit("/7")))
        .otherwise("NA")
        .alias("prescreen"),
        F.when(F.size("risks") > 0, F.concat_ws("; ", F.slice("risks", 1, 2)))
        .otherwise("NO_HARD_RISK")
        .alias("risk_text"),
        text(F.col("next_event_at")).alias("next_event_at"),
        text(F.col("entry_condition")).alias("entry_condition"),
        text(F.col("invalidation_condition")).alias("invalidation_condition"),
    )


def watchlist_rank(watchlist: DataFrame, metrics: DataFrame) -> DataFrame:
    """User watchlist by score, list order on ties."""
    scored = candidate_score(watchlist.join(metrics, "ticker", "left"))
    return (
        scored.withColumn("shown_score", F.when(F.col("score") > -90, F.col("score")))
        .withColumn("point_text", F.concat_ws("; ", F.slice("reasons", 1, 3)))
        .orderBy(F.desc("score"), F.asc("seq"))
    )


