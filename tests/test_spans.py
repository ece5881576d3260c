"""Fills of spans judged by a sweep, against walking each span's own fills."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from portledger.operators import outcomes as o

DAY = datetime(2024, 1, 2, tzinfo=timezone.utc)
ROWS = "decision_id string, ticker string, account_ref string, horizon string, decision_at timestamp, end_at timestamp, start_shares double"
FILLS = (
    "account_ref string, ticker string, side string, quantity double, price double, fees double, trade_time timestamp, "
    "trade_time_source string, seq long"
)


def judge(row, fills):
    _, ticker, account, _, begin, end, shares = row
    mine = sorted((f for f in fills if f[0] == account and f[1] == ticker and begin < f[6] <= end), key=lambda f: (f[6], f[8]))
    if not mine:
        return None
    if shares is None or shares <= 0:
        return len(mine), "START_SHARES_MISSING"
    for f in mine:
        if f[7] != "BROKER_EXECUTION_TIME":
            return len(mine), "TRADE_TIME_IS_PROXY"
        if f[5] is None:
            return len(mine), "FEES_MISSING"
    for f in mine:
        if f[2] not in ("BUY", "SELL"):
            return len(mine), "UNSUPPORTED_SIDE"
        shares += f[3] if f[2] == "BUY" else -f[3]
        if shares < 0:
            return len(mine), "SOLD_MORE_THAN_HELD"
    return len(mine), None


@pytest.mark.parametrize(("rare", "limits"), [(0.02, {}), (0.3, {"limit": 20})])
def test_spans_against_their_fills(spark, rare, limits):
    rng = random.Random(8)
    fills = []
    for i in range(700):
        fills.append(
            (f"A{rng.randrange(2)}", f"T{rng.randrange(2)}", "SHORT" if rng.random() < rare / 3 else rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 4)),
             10.0, None if rng.random() < rare / 3 else 0.5, DAY + timedelta(minutes=rng.randrange(6000)),
             "NOTIFICATION_TIME_PROXY" if rng.random() < rare / 3 else "BROKER_EXECUTION_TIME", i)
        )
    rows = []
    for d in range(120):
        begin = rng.choice([DAY + timedelta(minutes=rng.randrange(6000)), rng.choice(fills)[6]])
        shares = rng.choice([None, 0.0, 2.0, 5.0, 50.0])
        for horizon, minutes in (("1h", 60), ("1d", 900), ("5d", rng.randrange(900, 7000)), ("20d", None)):
            end = None if minutes is None else rng.choice([begin + timedelta(minutes=minutes), max(begin, rng.choice(fills)[6])])
            rows.append((f"D{d}", f"T{d % 2}", f"A{d % 3}", horizon, begin, end, shares))
    want = {(r[0], r[3]): judge(r, fills) for r in rows if r[5] is not None}
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {(r.decision_id, r.horizon): (r.fills, r.actual_note) for r in o.judge_spans(frame, spark.createDataFrame(fills, FILLS).repartition(3), **limits).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert {v[1] for v in got.values()} >= {None, "START_SHARES_MISSING", "FEES_MISSING"} | ({"SOLD_MORE_THAN_HELD"} if rare < 0.1 else set())


def test_late_knowledge_changes_nothing(spark):
    """A fill executed before, but parsed after, the cut-off is no fill of that time."""
    rules = o.OutcomeRules(as_of="2024-01-03 00:00:00", zone="UTC")
    at = DAY + timedelta(hours=10)
    rows = [(at, at, at + timedelta(hours=1), 1), (at, at, at + timedelta(days=2), 2), (at, at + timedelta(days=2), at + timedelta(days=2), 3), (at, at, None, 4), (at, at, at - timedelta(1), 5)]
    trades = spark.createDataFrame(rows, "trade_time timestamp, received_at timestamp, parsed_at timestamp, seq int")
    assert [r.seq for r in o.learnt_fills(trades, rules).collect()] == [1, 5]
    assert sorted(r.seq for r in o.learnt_too_early(trades).collect()) == [4, 5]
