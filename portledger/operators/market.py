"""Rules over metrics: technical state, market regime, market heat, environment.

Thresholds live in dataclasses; labels are codes. Missing input is reported as
missing, never read as neutral.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The benchmarks in report order, with name and role.
BENCHMARK_LABELS = (
    ("SPY", "S&P 500", "BROAD_MARKET"),
    ("QQQ", "Nasdaq 100", "TECH_GROWTH"),
    ("IWM", "Russell 2000", "SMALL_CAP_RISK"),
    ("SMH", "VanEck Semiconductor ETF", "SEMICONDUCTORS"),
    ("SOXX", "iShares Semiconductor ETF", "SEMICONDUCTORS_FALLBACK"),
    ("IGV", "iShares Expanded Tech-Software ETF", "SOFTWARE"),
    ("RSP", "Invesco S&P 500 Equal Weight ETF", "BREADTH"),
    ("HYG", "iShares High Yield Corporate Bond ETF", "CREDIT_RISK"),
    ("IEF", "iShares 7-10 Year Treasury Bond ETF", "TREASURY"),
    ("^VIX", "CBOE Volatility Index", "VOLATILITY"),
)
BENCHMARKS = tuple(ticker for ticker, _, _ in BENCHMARK_LABELS)


@dataclass(frozen=True)
class TechnicalRules:
    min_sessions: int = 21
    weak_gap_50: float = -5
    weak_gap_200: float = -3
    hot_rsi: float = 75
    oversold_rsi: float = 30
    healthy_gap_50: float = 3


def technical_state(rules: TechnicalRules = TechnicalRules()) -> Column:
    c = F.col
    missing = (
        c("close").isNull()
        | (F.coalesce("observation_count", F.lit(0)) < rules.min_sessions)
        | c("ret_20d_pct").isNull()
        | c("rsi_14").isNull()
    )
    weak = (c("sma_50_gap_pct") < rules.weak_gap_50) | (c("sma_200_gap_pct") < rules.weak_gap_200)
    healthy = (c("sma_50_gap_pct") > rules.healthy_gap_50) & (c("rel_spy_20d_pct") > 0)
    return (
        F.when(missing, "INSUFFICIENT_DATA")
        .when(weak, "WEAK")
        .when(c("rsi_14") >= rules.hot_rsi, "HOT")
        .when(c("rsi_14") <= rules.oversold_rsi, "OVERSOLD")
        .when(healthy, "HEALTHY")
        .otherwise("NEUTRAL")
    )


@dataclass(frozen=True)
class RegimeRules:
    off_spy_20d: float = -5
    off_qqq_20d: float = -7
    off_spy_gap_50: float = -3
    off_qqq_gap_50: float = -4
    off_vix: float = 22
    on_vix: float = 20


def _short(ticker: str) -> str:
    return ticker.strip("^").lower()


def benchmark_row(metrics: DataFrame) -> DataFrame:
    """One row with a struct per benchmark (NULL when absent), by conditional maximum.

    A SMH row that is present but empty still hides SOXX, as in the source rules.
    """
    fields = ("close", "ret_5d_pct", "ret_20d_pct", "rel_spy_20d_pct", "sma_50_gap_pct", "rsi_14")
    packed = F.struct(*[F.col(f).cast("double").alias(f) for f in fields])
    row = metrics.filter(F.col("ticker").isin(*BENCHMARKS)).agg(
        *[F.max(F.when(F.col("ticker") == t, packed)).alias(_short(t)) for t in BENCHMARKS]
    )
    return row.withColumn("semis", F.coalesce("smh", "soxx"))


def _missing(named: list[tuple[str, Column]]) -> Column:
    return F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in named]), lambda x: x.isNotNull()
    )


def _absent(member: str, field: str = "ret_20d_pct") -> Column:
    return F.col(f"{member}.close").isNull() | F.col(f"{member}.{field}").isNull()


def market_regime(metrics: DataFrame, rules: RegimeRules = RegimeRules()) -> DataFrame:
    """One row: regime code and the missing inputs."""
    c = F.col
    missing = _missing(
        [(n.upper(), _absent(n)) for n in ("spy", "qqq", "iwm", "igv")]
        + [("VIX", c("vix.close").isNull()), ("SMH/SOXX", _absent("semis"))]
    )
    off = (
        F.coalesce(c("spy.ret_20d_pct") <= rules.off_spy_20d, F.lit(False))
        | F.coalesce(c("qqq.ret_20d_pct") <= rules.off_qqq_20d, F.lit(False))
        | F.coalesce(c("spy.sma_50_gap_pct") <= rules.off_spy_gap_50, F.lit(False))
        | F.coalesce(c("qqq.sma_50_gap_pct") <= rules.off_qqq_gap_50, F.lit(False))
        | (c("vix.close") >= rules.off_vix)
    )
    on = (
        (c("spy.sma_50_gap_pct") > 0)
        & (c("qqq.sma_50_gap_pct") > 0)
        & (c("vix.close") < rules.on_vix)
        & (c("semis.ret_20d_pct") > 0)
    )
    return (
        benchmark_row(metrics)
        .withColumn("missing", missing)
        .select(
            F.when(F.size("missing") > 0, "INSUFFICIENT_DATA")
            .when(off, "RISK_OFF")
            .when(on, "RISK_ON")
            .otherwise("MIXED")
            .alias("regime"),
            F.concat_ws(",", "missing").alias("missing"),
            c("spy.ret_20d_pct").alias("spy_20d"),
            c("qqq.ret_20d_pct").alias("qqq_20d"),
            c("semis.rel_spy_20d_pct").alias("semis_rel_20d"),
            c("vix.close").alias("vix"),
        )
    )


def market_heat(metrics: DataFrame) -> DataFrame:
    """One row: heat score, count of hot benchmarks and the heat band."""
    c = F.col
    missing = _missing(
        [(n.upper(), _absent(n)) for n in ("spy", "qqq", "iwm", "rsp", "hyg", "ief")]
        + [("VIX", c("vix.close").isNull()), ("SMH/SOXX", _absent("semis", "rel_spy_20d_pct"))]
    )

    def vote(test: Column) -> Column:
        return F.coalesce(F.when(test, 1).when(~test, -1), F.lit(0))

    vix, vix5 = c("vix.close"), c("vix.ret_5d_pct")
    score = (
        vote(c("spy.ret_20d_pct") > 0)
        + vote(c("qqq.ret_20d_pct") > 0)
        + vote(c("rsp.rel_spy_20d_pct") >= 0)
        + vote(c("iwm.rel_spy_20d_pct") >= 0)
        + vote(c("hyg.ret_20d_pct") - c("ief.ret_20d_pct") >= 0)
        + vote(c("semis.rel_spy_20d_pct") >= 0)
        + F.when(vix >= 22, -2).when(vix >= 18, -1).when(vix < 16, 1).otherwise(0)
        + F.when(vix5 >= 20, -1).otherwise(0)
    )
    hot = sum(
        F.when(c(f"{n}.rsi_14") >= 70, 1).otherwise(0) for n in ("spy", "qqq", "semis")
    )
    return (
        benchmark_row(metrics)
        .withColumn("missing", missing)
        .withColumn("score", score)
        .withColumn("hot_rsi_count", hot)
        .select(
            F.when(F.size("missing") > 0, "UNCONFIRMED")
            .when((c("score") >= 4) & (c("hot_rsi_count") >= 2) & (vix < 16), "OVERHEATED")
            .when(c("score") >= 4, "HOT")
            .when(c("score") >= 2, "NEUTRAL_WARM")
            .when(c("score") >= 0, "NEUTRAL")
            .when(c("score") >= -2, "COOL")
            .otherwise("RISK_AVERSE")
            .alias("heat"),
            F.when(F.size("missing") == 0, c("score")).alias("score"),
            F.when(F.size("missing") == 0, c("hot_rsi_count")).alias("hot_rsi_count"),
            F.concat_ws(",", "missing").alias("missing"),
        )
    )


def hot_rsi_count(metrics: DataFrame, tickers: tuple[str, ...] = ("SPY", "QQQ", "SMH")) -> DataFrame:
    return metrics.filter(F.col("ticker").isin(*tickers)).agg(
        F.count_if(F.col("rsi_14") >= 70).alias("hot_rsi_count")
    )


def market_environment(metrics: DataFrame) -> DataFrame:
    """Fact rows of the benchmarks that have a price, with name, role and rank."""
    spark = metrics.sparkSession
    labels = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(BENCHMARK_LABELS)], "rank int, ticker string, name string, role string"
    )
    return (
        metrics.filter(F.col("close").isNotNull())
        .join(F.broadcast(labels), "ticker")
        .select(
            "rank", "ticker", "name", "role", "close", "price_as_of",
            "ret_1d_pct", "ret_5d_pct", "ret_20d_pct", "ret_60d_pct",
            F.when(F.col("ticker") != "SPY", F.col("rel_spy_20d_pct")).alias("rel_spy_20d_pct"),
            "rsi_14",
            F.when(F.col("ticker") == "^VIX", "VOLATILITY").otherwise(technical_state()).alias("state"),
        )
    )
