"""Worst falls along price paths of any length, without a list of the path.

Bars are summed up once in blocks of 1, 8, 64, ... minutes. A stretch of time is covered by few blocks of each size, found by
arithmetic, so its bars are a handful of equi-joined rows, whatever its length. Between two cash movements a
path's value is ``shares * price + cash``. A block keeps the price pairs (highest before, price) that can give its worst fall for any
shares and cash: the prices lower than all after them, and, for values below zero, those lower than all before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.operators.skew import attach

MINUTE = 60_000_000
#: Blocks of one size make one of the next; the largest size is RADIX ** (SIZES - 1) minutes.
RADIX, SIZES = 8, 5


def blocks(bars: DataFrame) -> DataFrame:
    """One row per (ticker, level, block): peak, the pairs ``falls`` and, of single minutes, their bars in order.

    A bar counts at its ``price_at``; a session's close counts after a minute of the same instant.
    """
    rows = bars.select(
        "ticker",
        F.unix_micros("price_at").alias("at"),
        (F.col("bar_type") == "DAILY_CLOSE").cast("int").alias("seq"),
        F.col("close").alias("price"),
    )
    minute = F.floor(F.col("at") / MINUTE).cast("long")
    single = rows.groupBy("ticker", minute.alias("block")).agg(
        F.max("price").alias("peak"), F.array_sort(F.collect_list(F.struct("at", "seq", "price"))).alias("bars")
    )
    sized = rows.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, SIZES)])))
    sized = sized.withColumn("block", F.floor(F.col("at") / (MINUTE * F.pow(F.lit(RADIX), F.col("level")).cast("long"))).cast("long"))
    key = ["ticker", "level", "block"]
    order = Window.partitionBy(*key).orderBy("at", "seq")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    price, high = F.col("price"), F.max("price").over(before)
    later, sooner = F.min("price").over(after), F.min("price").over(before)
    low = F.coalesce(price < later, F.lit(True)) & F.coalesce(price < high, F.lit(True))
    marked = sized.withColumn("_high", high).withColumn("_keep", low | F.coalesce(price < sooner, F.lit(True)))
    pair = F.struct(F.col("_high").alias("peak"), price.alias("low"))
    wide = marked.groupBy(*key).agg(F.max("price").alias("peak"), F.collect_list(F.when(F.col("_keep"), pair)).alias("falls"))
    none = single.withColumn("level", F.lit(0)).withColumn("falls", F.array().cast(wide.schema["falls"].dataType))
    return none.unionByName(wide.withColumn("bars", F.array().cast(single.schema["bars"].dataType)))


def units(a: Column, b: Column) -> list[Column]:
    """Arrays of blocks (level, block) that make up the whole numbers [a, b), few of each size."""

    def run(level: int, start: Column, end: Column) -> Column:
        some = F.sequence(start, end - 1)
        return F.when(
            start < end, F.transform(some, lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))
        ).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    def inner(level: int) -> tuple[Column, Column]:
        size = RADIX**level
        return F.ceil(a / size).cast("long"), F.floor(b / size).cast("long")

    parts = []
    for level in range(SIZES):
        start, end = inner(level)
        if level == SIZES - 1:
            parts.append(run(level, start, end))
            continue
        up, down = inner(level + 1)
        fits = up <= down
        parts += [run(level, start, F.when(fits, up * RADIX).otherwise(end)), run(level, F.when(fits, down * RADIX).otherwise(end), end)]
    return parts


def cover(lo: Column, hi: Column) -> Column:
    """Blocks (level, block) that make up [lo, hi) in microseconds; its first and last minute are single ones."""
    first, last = F.floor(lo / MINUTE).cast("long"), F.floor((hi - 1) / MINUTE).cast("long")
    edge = F.array_distinct(
        F.array(*[F.struct(F.lit(0).alias("level"), m.alias("block")) for m in (first, last)])
    )
    return F.when(lo < hi, F.concat(edge, *units(first + 1, last)))


def extremes(stretches: DataFrame, table: DataFrame, path: Sequence[str], **limits) -> DataFrame:
    """worst (a share, at most 0) and peak (highest value) of each stretch with bars, by ``path`` and ``part``.

    ``stretches`` has the columns of ``path``, part (their order), ticker, lo and hi (microseconds, hi excluded),
    shares, cash and initial, the value a path starts with (NULL: its first bar). Falls are measured from the
    highest value of the whole path so far. ``table`` is what ``blocks`` gives.
    """
    path = list(path)
    given = [*path, "part", "ticker", "lo", "hi", "shares", "cash", "initial"]
    pieces = stretches.select(*dict.fromkeys(given), F.explode(cover(F.col("lo"), F.col("hi"))).alias("_b")).select("*", "_b.*").drop("_b")
    found = attach(pieces, table, ["ticker", "level", "block"], how="inner", **limits)
    inside = F.filter("bars", lambda b: (b["at"] >= F.col("lo")) & (b["at"] < F.col("hi")))
    found = found.withColumn("_in", F.transform(inside, lambda b: b["price"]))
    single = F.transform("_in", lambda p, i: F.struct(F.array_max(F.slice("_in", 1, i)).alias("peak"), p.alias("low")))
    alone = F.col("level") == 0
    found = found.filter(~alone | (F.size("_in") > 0)).select(
        *dict.fromkeys(given),
        (F.col("block") * F.pow(F.lit(RADIX), F.col("level")).cast("long")).alias("_start"),
        F.when(alone, F.array_max("_in")).otherwise(F.col("peak")).alias("_peak"),
        F.when(alone, single).otherwise(F.col("falls")).alias("_falls"),
    )

    def value(price: Column) -> Column:
        return F.col("shares") * price + F.col("cash")

    order = Window.partitionBy(*path).orderBy("part", "_start").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_prior", F.greatest("initial", F.max(value(F.col("_peak"))).over(order)))
    falls = F.transform("_falls", lambda f: value(f["low"]) / F.greatest("_prior", value(f["peak"])) - 1.0)
    found = found.withColumn("_worst", F.least(F.array_min(falls), F.lit(0.0)))
    return found.groupBy(*path, "part").agg(F.min("_worst").alias("worst"), F.max(value(F.col("_peak"))).alias("peak"))
