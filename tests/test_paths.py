"""Falls along paths, from blocks, against walking every bar."""

import random

import pytest
from pyspark.sql import functions as F

from portledger.operators import paths

START = 1_700_000_000_000_000


def test_cover_is_every_minute_once(spark):
    rng = random.Random(1)
    spans = [(lo, lo + rng.choice([0, 1, 59, 60, 61, 3600, 90_000, 2_000_000]) * 1_000_000 + rng.randrange(2)) for lo in (START + rng.randrange(10**11) for _ in range(200))]
    frame = spark.createDataFrame(spans, "lo long, hi long")
    for row in frame.withColumn("b", paths.cover(F.col("lo"), F.col("hi"))).collect():
        if row.lo >= row.hi:
            assert row.b is None
            continue
        minutes = [m for b in row.b for m in range(b.block * 8**b.level, (b.block + 1) * 8**b.level)]
        assert sorted(minutes) == list(range(row.lo // paths.MINUTE, (row.hi - 1) // paths.MINUTE + 1))
        assert len(row.b) <= 2 + 2 * 7 * 4 + (row.hi - row.lo) // (paths.MINUTE * 8**4)


def walk(bars, lo, hi, segments, initial):
    """Worst fall so far after each segment (lo, hi, shares, cash), bar by bar."""
    peak, worst, out = initial, 0.0, []
    for lo, hi, shares, cash in segments:
        high = None
        for at, _, price in bars:
            if lo <= at < hi:
                value = shares * price + cash
                peak = value if peak is None else max(peak, value)
                worst, high = min(worst, value / peak - 1), value if high is None else max(high, value)
        out.append((worst, high))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_falls_of_segments(spark, seed):
    """Cash movements, values below zero, ties, closes on the instant of a minute, gaps and empty stretches."""
    rng = random.Random(seed)
    bars = []
    for day in range(12):
        for minute in sorted(rng.sample(range(390), rng.choice([0, 3, 200]))):
            bars.append((START + (day * 1440 + minute) * paths.MINUTE, 0, round(rng.choice([10, 50, 100]) * rng.uniform(0.5, 1.5), rng.choice([0, 2]))))
        if bars and rng.random() < 0.8:
            bars.append((bars[-1][0], 1, rng.uniform(20, 90)))
    frame = spark.createDataFrame([("T", a, "DAILY_CLOSE" if s else "INTRADAY", p) for a, s, p in bars], "ticker string, at long, bar_type string, close double")
    table = paths.blocks(frame.withColumn("price_at", F.timestamp_micros("at"))).cache()
    want, rows = {}, []
    for k in range(60):
        cuts = sorted(START + rng.randrange(12 * 1440) * paths.MINUTE + rng.choice([0, 1, 30_000_000]) for _ in range(rng.randrange(2, 6)))
        initial = rng.choice([None, 300.0, 20.0])
        # A path without a value to start from holds shares, as its falls are shares of what it was worth.
        segments = [(a, b, rng.choice([0.0, 1.0, 5.0]) if initial else 1.0, rng.choice([0.0, 40.0, -150.0]) if initial else 0.0) for a, b in zip(cuts, cuts[1:])]
        want[k] = walk(bars, cuts[0], cuts[-1], segments, initial)
        rows += [(k, i, "T", a, b, h, c, initial) for i, (a, b, h, c) in enumerate(segments)]
    stretches = spark.createDataFrame(rows, "path int, part int, ticker string, lo long, hi long, shares double, cash double, initial double")
    got = {(r.path, r.part): r for r in paths.extremes(stretches, table, ["path"]).collect()}
    for k, expected in want.items():
        worst = 0.0
        for part, (so_far, high) in enumerate(expected):
            found = got.get((k, part))
            worst = min(worst, found.worst if found else 0.0)
            assert worst == pytest.approx(so_far, abs=1e-12), (k, part)
            assert (found is None) == (high is None) and (found is None or found.peak == pytest.approx(high))
