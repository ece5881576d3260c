"""Work that grows with what differs: shared paths, one walk for all horizons, narrow reductions, one write a batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from portledger.operators import outcomes, paths, positions as p, review
from portledger.streaming import ledgers as streams

START = 1_700_000_000_000_000


def test_decisions_of_one_bar_share_a_path(spark, monkeypatch):
    """Copies of a decision, other ends on the same path, other paths and rows without an end."""
    rng = random.Random(5)
    bars = [("T", START + m * paths.MINUTE, "INTRADAY", rng.uniform(50, 150)) for m in range(400)]
    table = paths.blocks(spark.createDataFrame(bars, "ticker string, at long, bar_type string, close double").withColumn("price_at", F.timestamp_micros("at")))
    rows = []
    for n in range(40):
        first = rng.choice([3, 60])
        rows += [(f"D{n}", "T", h, START + first * paths.MINUTE, bars[first][3], START + e * paths.MINUTE if e else None) for h, e in (("1h", first + rng.choice([9, 60])), ("close", 390), ("5d", None))]
    rows.append((rows[0][0], *rows[0][1:]))
    frame = spark.createDataFrame(rows, "decision_id string, ticker string, horizon string, r long, reference_price double, e long")
    frame = frame.select("decision_id", "ticker", "horizon", F.timestamp_micros("r").alias("reference_at"), "reference_price", F.timestamp_micros("e").alias("end_at"))
    seen, plain = [], outcomes.extremes

    def counted(stretches, *args, **kwargs):
        seen.append(stretches.count())
        return plain(stretches, *args, **kwargs)

    monkeypatch.setattr(outcomes, "extremes", counted)
    got = outcomes.with_hold_path(frame, table).select("decision_id", "horizon", "hold_max_drawdown_pct").collect()
    want = []
    for name, _, horizon, start, price, end in rows:
        peak, worst = price, 0.0
        for _, at, _, close in bars:
            if end and start < at <= end:
                peak = max(peak, close)
                worst = min(worst, close / peak - 1.0)
        want.append((name, horizon, worst * 100.0 if end else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert seen == [6]


def test_candidate_outcomes_walk_once(spark):
    """Gaps, a ticker of one session and missing values, against walking every horizon apart."""
    rng = random.Random(8)
    day = dt.date(2024, 1, 1)
    calendar = spark.createDataFrame([(day + dt.timedelta(i), i) for i in range(60)], "session_date date, session_idx int")
    closes = {(t, i): (rng.choice([None, rng.uniform(5, 9), rng.uniform(5, 9)]), rng.uniform(90, 110)) for t in "AB" for i in range(60) if rng.random() < 0.7}
    closes["C", 7] = (3.0, 100.0)
    frame = spark.createDataFrame([(t, day + dt.timedelta(i), c, b) for (t, i), (c, b) in closes.items()], "ticker string, session_date date, close double, bench_close double")
    out = review.candidate_outcomes(frame.select("ticker", "session_date"), frame, calendar)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    found = {(r.ticker, (r.session_date - day).days): r for r in out.collect()}
    assert found.keys() == closes.keys()
    before = {}
    for t in "ABC":
        days = sorted(i for s, i in closes if s == t)
        before |= {(t, b): (t, a) for a, b in zip(days, days[1:])}
    for (t, i), (close, bench) in closes.items():
        for k in (1, 5, 20):
            ahead = [(j, closes[t, j][0]) for j in range(i + 1, i + k + 1) if (t, j) in closes]
            end, mark = closes.get((t, i + k), (None, None))
            ret = (end / close - 1) * 100 if end and close else None
            steps = [c / closes[before[t, j]][0] - 1 for j, c in ahead if c and closes[before[t, j]][0]]
            peak, worst = close, 0.0
            for _, c in ahead:
                if c is not None:
                    peak = max(peak, c) if peak is not None else c
                    worst = min(worst, c / peak - 1)
            row = found[t, i]
            assert row[f"ret_{k}"] == (ret if ret is None else pytest.approx(ret, abs=1e-9))
            assert row[f"rel_{k}"] == (ret if ret is None else pytest.approx(ret - (mark / bench - 1) * 100, abs=1e-9))
            assert row[f"worst_day_{k}"] == (pytest.approx(min(steps) * 100, abs=1e-9) if steps else None)
            assert row[f"drawdown_{k}"] == pytest.approx(worst * 100, abs=1e-9)


def test_runs_equal_plain_reduction(spark):
    """Sums and firsts taken by plain aggregates, the rest in order, against the composition of whole steps."""
    rng = random.Random(4)
    rows = []
    for n in range(400):
        kind, side = rng.choice([("TRADE", "BUY"), ("TRADE", "SELL"), ("TRADE", "SELL"), ("STOCK_REWARD", "CREDIT")])
        rows.append((rng.choice("ab"), rng.choice("XYZ"), kind, side, float(rng.randrange(1, 4)), 5.0, rng.choice([None, 0.5]), START + n * 10**6, n, rng.choice([None, "N1", "N2"])))
    frame = spark.createDataFrame(rows, "account_ref string, ticker string, event_type string, side string, quantity double, price double, fees double, at long, seq long, company_name string")
    fills = p.prepare(frame.withColumn("trade_time", F.timestamp_micros("at")))
    order = p.order_of(fills)
    moved = p.running_quantity(fills, order)
    steps = moved.select(*order.chunk, "_rn", F.floor((F.col("_rn") - 1) / 7).alias("_run"), p._step().alias("step"))
    keys = [*order.chunk, "_run"]
    got, want = p._runs(steps, keys), p._reduce(steps, keys, ["_rn"])
    assert got.schema["step"].dataType.names == want.schema["step"].dataType.names
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_is_written_once(spark):
    """Rows of a batch lie in one table, late ones apart; nothing is copied before."""
    rows = [("x", "A", "BUY", 1.0, 2.0, 0.0, at, i, 0, arrival) for i, (at, arrival) in enumerate([(5, 1), (9, 2), (1, 3), (12, 4), (3, 5), (20, 6)])]
    df = spark.createDataFrame(rows, "account_ref string, ticker string, side string, quantity double, price double, fees double, pos long, item long, tie long, seq long")
    row = streams.live_positions(df, "once-test").first()
    assert (row.fills, row.refused, row.shares, row.total_cost) == (6, 0, 6.0, 12.0)
    from pathlib import Path

    names = {f.name.rsplit("-", 1)[0] for f in (Path(spark.conf.get("spark.checkpoint.dir")) / "portledger").iterdir()}
    assert "once-test-applied" in names and not {"once-test-batch", "once-test-late"} & names
