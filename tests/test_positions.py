"""Average-cost replay: hand cases, flags, and random ledgers against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from portledger.operators import positions as p
from portledger.operators.scans import DAY
from portledger.streaming import ledgers as streams

START = dt.datetime(2026, 7, 1, 13, 30)
SCHEMA = (
    "account_ref string, ticker string, event_type string, side string, quantity decimal(20,8), "
    "price decimal(20,8), fees decimal(20,8), trade_time timestamp, seq long"
)
HOT = {"limit": 5}


def fill(n, side, q, price=None, fees=None, account="a", ticker="T", kind="TRADE", days=0):
    from decimal import Decimal

    def d(x):
        return None if x is None else Decimal(str(x))

    return (account, ticker, kind, side, d(q), d(price), d(fees), START + dt.timedelta(days=days), n)


def fold(spark, rows, anchors=None, **kw):
    return p.fold(p.prepare(spark.createDataFrame(rows, SCHEMA), anchors), **kw)


def test_buy_then_partial_sell(spark):
    row = fold(spark, [fill(1, "BUY", 10, 100, 1), fill(2, "SELL", 4, 120, 1, days=1)]).first()
    assert float(row.shares) == 6
    assert row.avg_cost == pytest.approx(100.1)
    assert row.realised_pnl == pytest.approx(78.6)
    assert row.cost_known and row.fees_complete and not row.oversold
    assert row.entry_date == dt.date(2026, 7, 1)


def test_reward_makes_cost_unknown_until_closed(spark):
    rows = [fill(1, "CREDIT", "0.2396", kind="STOCK_REWARD")]
    row = fold(spark, rows).first()
    assert row.avg_cost is None and not row.cost_known and not row.fees_complete
    rows += [fill(2, "SELL", "0.2396", 50, 0, days=1), fill(3, "BUY", 2, 10, 1, days=2)]
    row = fold(spark, rows).first()
    assert row.cost_known and row.avg_cost == pytest.approx(10.5)
    assert row.realised_pnl is None and not row.realised_complete
    assert row.entry_date == dt.date(2026, 7, 3)


def test_anchor_seeds_and_hides_earlier_fills(spark):
    anchors = spark.createDataFrame(
        [("a", "T", "10", "100", dt.date(2026, 1, 2), START)],
        "account_ref string, ticker string, shares string, avg_cost string, entry_date date, anchor_at timestamp",
    ).withColumns({c: F.col(c).cast("decimal(20,8)") for c in ("shares", "avg_cost")})
    rows = [fill(1, "BUY", 99, 1, 0, days=-1), fill(2, "SELL", 4, 110, 0, days=1)]
    row = fold(spark, rows, anchors).first()
    assert float(row.shares) == 6 and row.avg_cost == pytest.approx(100)
    assert row.entry_date == dt.date(2026, 1, 2) and row.applied == 1 and not row.fees_complete


def test_missing_fees_on_a_sell_spoil_realised(spark):
    row = fold(spark, [fill(1, "BUY", 10, 100, 1), fill(2, "SELL", 4, 120, None, days=1)]).first()
    assert row.realised_pnl is None and not row.fees_complete and row.cost_known


def test_oversell_is_reported_once_with_the_first_sell(spark):
    rows = [fill(1, "BUY", 5, 10, 0), fill(2, "SELL", 6, 10, 0, days=1), fill(3, "SELL", 1, 10, 0, days=2)]
    bad = p.oversold(p.prepare(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.seq, float(r.held)) for r in bad] == [(2, 5.0)]
    assert fold(spark, rows).first().oversold


def loop(rows):
    """The rule book, one fill after another."""
    out = {}
    for account, ticker, kind, side, q, price, fees, at, seq in sorted(rows, key=lambda r: (r[7], r[8])):
        s = out.setdefault((account, ticker), dict(q=0.0, c=0.0, known=True, fees=True, r=0.0, rc=True, entry=None))
        q = float(q)
        if side != "SELL" and round(s["q"], 8) == 0:
            s["entry"] = at.date()
        if kind == "STOCK_REWARD":
            s["q"] += q
            s["known"] = s["fees"] = False
            continue
        s["fees"] = s["fees"] and fees is not None
        paid = float(fees or 0)
        if side == "BUY":
            if s["known"]:
                s["c"] += q * float(price) + paid
            s["q"] += q
            continue
        if s["known"]:
            avg = s["c"] / s["q"]
            s["r"] += q * (float(price) - avg) - paid
            s["c"] -= q * avg
        else:
            s["rc"] = False
        s["rc"] = s["rc"] and fees is not None
        s["q"] = round(s["q"] - q, 8)
        if s["q"] == 0:
            s.update(c=0.0, known=True, fees=True, entry=None)
    return out


def random_ledger(seed, n=260):
    rng, rows, held = random.Random(seed), [], {}
    for i in range(n):
        key = ("hot", "T") if i % 3 else (f"a{rng.randrange(3)}", rng.choice("XY"))
        have = held.get(key, 0)
        kind, side, q = "TRADE", "BUY", rng.randrange(1, 9)
        if have and rng.random() < 0.45:
            side, q = "SELL", have if rng.random() < 0.25 else rng.randrange(1, have + 1)
        elif rng.random() < 0.06:
            kind, side = "STOCK_REWARD", "CREDIT"
        held[key] = have + (-q if side == "SELL" else q)
        fees = None if rng.random() < 0.04 else rng.randrange(0, 5)
        rows.append(fill(i, side, q, rng.randrange(5, 50), fees, *key, kind=kind, days=i // 9))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_ledgers_match_the_loop(spark, seed):
    rows = random_ledger(seed)
    want = loop(rows)
    for kw in ({}, {"run": 3, **HOT, "order": None}):
        got = {(r.account_ref, r.ticker): r for r in fold(spark, rows, **kw).collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            g = got[key]
            assert float(g.shares) == pytest.approx(w["q"])
            assert g.cost_known == w["known"] and g.fees_complete == w["fees"], key
            assert g.realised_complete == w["rc"] and g.entry_date == w["entry"], key
            if w["rc"]:
                assert g.realised_pnl == pytest.approx(w["r"])
            if w["known"] and w["q"]:
                assert g.total_cost == pytest.approx(w["c"])


def test_small_chunks_cut_one_busy_day(spark):
    rows = [fill(i, "BUY" if i % 4 else "SELL", 1, 10 + i % 7, 1, days=i // 200) for i in range(1, 400)]
    prepared = p.prepare(spark.createDataFrame(rows, SCHEMA))
    plain = p.fold(prepared).first()
    cut = p.fold(prepared, order=p.order_of(prepared, width=DAY), run=4, **HOT).first()
    assert plain.shares == cut.shares and plain.avg_cost == pytest.approx(cut.avg_cost)
    exact = p.fold_small(prepared).first()
    assert float(exact.total_cost) == pytest.approx(cut.total_cost)


def test_consolidate_keeps_unknown_cost_visible(spark):
    rows = [fill(1, "BUY", 10, 100, 1, account="a"), fill(2, "CREDIT", 1, account="b", kind="STOCK_REWARD")]
    row = p.consolidate(fold(spark, rows)).first()
    assert float(row.shares) == 11 and row.avg_cost is None and not row.cost_known and row.accounts == 2


def test_stream_applies_late_fills(spark):
    """Keys: in order, late buy, late sell, late fill that turns a sale into a refused one, and rows after it."""
    fills = [  # ticker, side, quantity, price, day of the trade, arrival
        ("A", "BUY", 10, 5.0, 1, 1), ("A", "SELL", 4, 6.0, 5, 2), ("A", "BUY", 1, 7.0, 9, 3),
        ("B", "BUY", 10, 5.0, 3, 1), ("B", "BUY", 10, 9.0, 1, 2), ("B", "SELL", 5, 8.0, 6, 3),
        ("C", "BUY", 10, 5.0, 1, 1), ("C", "BUY", 10, 7.0, 6, 1), ("C", "SELL", 10, 6.0, 4, 3),
        ("D", "BUY", 5, 5.0, 1, 1), ("D", "SELL", 5, 6.0, 7, 1), ("D", "SELL", 3, 8.0, 4, 2), ("D", "BUY", 2, 1.0, 8, 3),
    ]
    rows = [("x", t, side, float(q), price, 0.5, day * 86_400_000_000, i, 0, at) for i, (t, side, q, price, day, at) in enumerate(fills)]
    df = spark.createDataFrame(
        rows, "account_ref string, ticker string, side string, quantity double, price double, fees double, pos long, item long, tie long, seq long"
    )
    want = {}
    for t, side, q, price, _, _ in sorted(fills, key=lambda f: f[4]):
        n, refused, shares, cost, realised = want.get(t, (0, 0, 0.0, 0.0, 0.0))
        if side == "BUY":
            shares, cost = shares + q, cost + q * price + 0.5
        elif q > shares:
            refused += 1
        else:
            realised += q * (price - cost / shares) - 0.5
            shares, cost = shares - q, (cost - q * cost / shares if shares > q else 0.0)
        want[t] = (n + 1, refused, shares, cost, realised)
    found = {r.ticker: tuple(r)[2:] for r in streams.live_positions(df, "late-fills-test").collect()}
    assert {t: [round(x, 6) for x in v] for t, v in found.items()} == {t: [round(x, 6) for x in v] for t, v in want.items()}
