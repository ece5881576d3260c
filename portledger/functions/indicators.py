"""Last values of recursive averages as weighted sums.

An exponential average seeded with the first value,
``y_1 = x_1, y_i = (1-a) y_{i-1} + a x_i``, ends at
``sum c_j q^(n-j) x_j`` with ``q = 1-a``, ``c_1 = 1`` and ``c_j = a`` otherwise.
With the row number ``j`` and the row count ``n`` at hand it is a plain ``sum``:
no per-row state, partial aggregation and generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ema_last(x: Column, j: Column, n: Column, alpha: float) -> Column:
    weight = F.when(j == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), n - j)
    return F.sum(weight * x)


def rsi_last(change: Column, j: Column, n: Column, window: int = 14) -> Column:
    """Wilder RSI of the last row; the first change counts as 0."""
    up = F.when(change > 0, change).otherwise(0.0)
    down = F.when(change < 0, -change).otherwise(0.0)
    gain = ema_last(up, j, n, 1.0 / window)
    loss = ema_last(down, j, n, 1.0 / window)
    value = F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    return F.when(F.max(n) >= window, value)


def _macd_weight(j: Column, n: Column, span: int, slow: int, signal: int) -> Column:
    """Weight of price j, by way of an average of ``span``, in the last signal value."""
    a, s = 2.0 / (span + 1), 1.0 - 2.0 / (signal + 1)
    q = 1.0 - a
    m = F.greatest(j, F.lit(slow))
    run = n - m + 1
    steady = (
        (1.0 - s)
        * F.pow(F.lit(q), m - j)
        * (F.pow(F.lit(s), run) - F.pow(F.lit(q), run))
        / (s - q)
    )
    seed = F.when(j <= slow, s * F.pow(F.lit(s), n - slow) * F.pow(F.lit(q), slow - j)).otherwise(0.0)
    return F.when(j == 1, 1.0).otherwise(a) * (steady + seed)


def macd_hist_last(
    x: Column, j: Column, n: Column, fast: int = 12, slow: int = 26, signal: int = 9
) -> Column:
    """MACD minus its signal at the last row; the signal starts at row ``slow``."""
    line = ema_last(x, j, n, 2.0 / (fast + 1)) - ema_last(x, j, n, 2.0 / (slow + 1))
    weight = _macd_weight(j, n, fast, slow, signal) - _macd_weight(j, n, slow, slow, signal)
    return F.when(F.max(n) >= slow + signal - 1, line - F.sum(weight * x))


def atr_last(true_range: Column, j: Column, n: Column, window: int = 14) -> Column:
    """Wilder ATR of the last row, seeded with the mean of the first ``window`` ranges."""
    keep = 1.0 - 1.0 / window
    age = F.pow(F.lit(keep), n - F.greatest(j, F.lit(window)))
    return F.when(F.max(n) >= window, F.sum(true_range * age / window))
