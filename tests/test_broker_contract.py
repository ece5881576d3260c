"""The broker contract, rule by rule, and a replay in plain Python beside the reduction."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from portledger.operators import positions as p

SCHEMA = (
    "account_ref string, ticker string, event_type string, side string, quantity decimal(20,8), price decimal(20,8), fees decimal(20,8), "
    "currency string, trade_time timestamp, company_name string, seq long"
)
GOOD = ("A", " abc ", "TRADE", "buy", Decimal(5), Decimal(10), None, "usd", datetime(2024, 1, 2), None, 1)


def row(**changes):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({}, None),
        ({"trade_time": None}, "TRADE_TIME_MISSING"),
        ({"event_type": "DIVIDEND"}, "UNSUPPORTED_EVENT_TYPE"),
        ({"event_type": None}, "UNSUPPORTED_EVENT_TYPE"),
        ({"side": "SHORT"}, "UNSUPPORTED_SIDE"),
        ({"side": None}, "UNSUPPORTED_SIDE"),
        ({"side": "CREDIT"}, "UNSUPPORTED_SIDE"),
        ({"event_type": "STOCK_REWARD"}, "UNSUPPORTED_SIDE"),
        ({"event_type": "STOCK_REWARD", "side": "CREDIT", "price": None}, None),
        ({"ticker": "A B"}, "INVALID_TICKER"),
        ({"ticker": None}, "INVALID_TICKER"),
        ({"currency": "HKD"}, "NON_USD"),
        ({"currency": None}, "NON_USD"),
        ({"quantity": Decimal(0)}, "BAD_QUANTITY"),
        ({"quantity": None}, "BAD_QUANTITY"),
        ({"price": None}, "BAD_PRICE"),
        ({"price": Decimal(-1)}, "BAD_PRICE"),
        ({"fees": Decimal(-1)}, "BAD_FEES"),
        ({"side": "SHORT", "currency": "HKD", "quantity": Decimal(0)}, "UNSUPPORTED_SIDE"),
    ],
)
def test_rules(spark, changes, rule):
    assert p.broker_rules(spark.createDataFrame([row(**changes)], SCHEMA)).first().rule == rule


def walk(rows):
    """One position, fill by fill."""
    q = cost = realised = Decimal(0)
    known = fees_ok = complete = True
    name = None
    for _, _, kind, side, n, price, fees, _, _, company, _ in rows:
        name = (company or "").strip() or name
        if kind == "STOCK_REWARD":
            q, known, fees_ok = q + n, False, False
            continue
        fees_ok = fees_ok and fees is not None
        if side == "BUY":
            cost, q = cost + (n * price + (fees or 0) if known else 0), q + n
            continue
        if known:
            average = cost / q
            realised, cost = realised + n * (price - average) - (fees or 0), cost - n * average
        else:
            complete, cost = False, Decimal(0)
        complete, q = complete and fees is not None, q - n
        if not q:
            cost, known, fees_ok = Decimal(0), True, True
    return q, cost if known and q else None, realised if complete else None, known, fees_ok, name


@pytest.mark.parametrize("limits", [{}, {"limit": 7}])
def test_replay_with_rewards_closings_and_names(spark, limits):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(25):
        held, mine = 0, []
        for i in range(rng.randrange(1, 60)):
            reward = rng.random() < 0.1
            sell = not reward and held and rng.random() < 0.45
            n = rng.choice([held, rng.randrange(1, held + 1)]) if sell else rng.randrange(1, 20)
            held += -n if sell else n
            when = datetime(2024, 1, 2) + timedelta(days=i // 3)
            mine.append(
                (f"A{k % 3}", f"T{k}", "STOCK_REWARD" if reward else "TRADE", "CREDIT" if reward else "SELL" if sell else "BUY", Decimal(n),
                 None if reward else Decimal(rng.randrange(50, 150)), rng.choice([None, Decimal(1)]) if not reward else None, "USD", when,
                 rng.choice([None, " ", f"N{i}"]), k * 1000 + i)
            )
        rows += mine
        want[f"T{k}"] = walk(mine)
    refused = row(account_ref="A0", ticker="T0", side="SHORT", seq=99_999)
    found = {r.ticker: r for r in p.replay(spark.createDataFrame([*rows, refused], SCHEMA).repartition(5), **limits).collect()}
    assert found.keys() == want.keys()
    assert found["T0"].refused == 1 and found["T0"].shares is None and found["T0"].total_cost is None
    for ticker, (q, cost, realised, known, fees_ok, name) in want.items():
        r = found[ticker]
        if ticker == "T0":
            continue
        assert (r.shares, r.company_name, r.refused) == (q, name, 0)
        assert (r.cost_known, r.fees_complete) == (known or not q, fees_ok or not q)
        assert (r.total_cost is None) == (cost is None) and (cost is None or r.total_cost == pytest.approx(float(cost)))
        assert (r.realised_pnl is None) == (realised is None) and (realised is None or r.realised_pnl == pytest.approx(float(realised)))


def test_a_fill_without_a_known_side_stops_the_fold(spark):
    trades = spark.createDataFrame([row(side="SHORT")], SCHEMA)
    with pytest.raises(Exception, match="without a known side"):
        p.prepare(trades).collect()


def test_a_replay_writes_its_fills_once_and_only_what_it_reads(spark, monkeypatch):
    from portledger.operators import positions

    written, write = {}, positions.staged
    monkeypatch.setattr(positions, "staged", lambda df, name: written.setdefault(name, df.columns) and write(df, name))
    rows = spark.createDataFrame([row()], SCHEMA)
    assert positions.replay(rows).count() == 1
    assert list(written) == ["judged-fills"] and "currency" not in written["judged-fills"]
