"""Ordered scans (running sums, maxima, last values) over groups of any size.

A plain window sends a whole group to one task. Here a group is first cut into
consecutive chunks: one per ``width`` of the order position, and chunks of more
than a fixed number of rows are cut again. Each chunk runs its own window, one summary row
per chunk carries the state over from the chunks before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from portledger.operators.skew import ROWS, hot_groups
from portledger.sources.staging import staged

DAY = 86_400_000_000


@dataclass(frozen=True)
class Order:
    """Rows of a group ordered by ``pos`` (bigint), then ``tie`` (bigint), then ``rest``."""

    keys: tuple[str, ...]
    pos: str
    tie: str
    width: int = 30 * DAY
    rest: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.pos, self.tie, *self.rest]

    @property
    def chunk(self) -> list[str]:
        return [*self.keys, "_bucket", "_part"]


#: Pieces a cut makes of a hot group at most, a power of two; a second cut makes as many of each piece.
PIECES = 128


def _cut(df: DataFrame, order: Order, group: list[str], limit: int) -> DataFrame | None:
    """Add ``_cut``: hot groups cut at quantiles of (position, tie), so a busy instant is cut as well.

    None where no group is hot.
    """
    ends = [F.min(order.pos).alias("_p0"), F.min(order.tie).alias("_t0"), F.max(order.tie).alias("_t1")]
    hot = hot_groups(df, group, stats=ends, limit=limit)
    if hot.isEmpty():
        return None
    inside = (F.col(order.tie) - F.col("_t0")) / (F.col("_t1") - F.col("_t0") + 1.0)
    place = (F.col(order.pos) - F.col("_p0")).cast("double") + F.coalesce(inside, F.lit(0.0))
    shares = [i / PIECES for i in range(1, PIECES)]
    marks = df.join(hot, group).groupBy(*group).agg(
        F.percentile_approx(place, shares, 100 * PIECES).alias("_marks"),
        *[F.first(c).alias(c) for c in ("_p0", "_t0", "_t1")],
    )
    cut = df.join(staged(marks, "cut-marks"), group, "left").withColumn("_place", place).withColumn("_cut", F.lit(0))
    # How many marks lie at or before the place: a binary search over PIECES - 1 sorted marks, one bit a column.
    step = PIECES // 2
    while step:
        reached = F.col("_marks")[F.col("_cut") + (step - 1)] <= F.col("_place")
        cut = cut.withColumn("_cut", F.col("_cut") + F.when(reached, step).otherwise(0))
        step //= 2
    return cut.drop("_marks", "_p0", "_t0", "_t1", "_place")


def with_chunks(df: DataFrame, order: Order, *, limit: int = ROWS) -> DataFrame:
    """Add ``_bucket`` and ``_part``; (bucket, part) never decreases along the order."""
    keys = list(order.keys)
    bucketed = df.withColumn("_bucket", F.floor(F.col(order.pos) / order.width).cast("long"))
    first = _cut(bucketed, order, [*keys, "_bucket"], limit)
    if first is None:
        return bucketed.withColumn("_part", F.lit(0))
    # Read again by the second cut and by every pass of a scan.
    first = staged(first.withColumnRenamed("_cut", "_part"), "chunks")
    second = _cut(first, order, [*keys, "_bucket", "_part"], limit)
    if second is None:
        return first.withColumn("_part", F.col("_part") * PIECES)
    return second.withColumn("_part", F.col("_part") * PIECES + F.col("_cut")).drop("_cut")


# kind -> (aggregate of a chunk, running aggregate, how carry and local combine)
def _summary(kind: str, c: Column, order: Order) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    if kind == "last":
        # NULL rows do not take part; the order key decides.
        return F.max_by(c, F.when(c.isNotNull(), F.struct(*order.columns)))
    raise ValueError(kind)


def _running(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "max": F.max}[kind](c) if kind != "last" else F.last(c, True)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry + local, local, carry)
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def running(
    chunked: DataFrame,
    order: Order,
    exprs: Mapping[str, tuple[str, Column, bool]],
    row_number: str | None = None,
) -> DataFrame:
    """Add running columns ``name -> (kind, value, inclusive)`` to a chunked table.

    ``kind`` is ``sum``, ``max`` or ``last`` (last non-NULL value). Exclusive
    columns see only the rows strictly before the current one. ``row_number``
    names a column for the rank inside the chunk.
    """
    summaries = chunked.groupBy(*order.chunk).agg(
        *[_summary(kind, value, order).alias(f"_c_{n}") for n, (kind, value, _) in exprs.items()]
    )
    earlier = (
        Window.partitionBy(*order.keys)
        .orderBy("_bucket", "_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = summaries.select(
        *order.chunk,
        *[_running(kind, F.col(f"_c_{n}")).over(earlier).alias(f"_k_{n}") for n, (kind, _, _) in exprs.items()],
    )
    inside = Window.partitionBy(*order.chunk).orderBy(*order.columns)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # A plain column is scanned as it is: a copy of it would be shuffled as well.
    local = chunked.select(
        *chunked.columns,
        *[
            _running(kind, value).over(upto if inclusive else before).alias(f"_l_{n}")
            for n, (kind, value, inclusive) in exprs.items()
        ],
        *([F.row_number().over(inside).alias(row_number)] if row_number else []),
    )
    joined = local.join(carries, order.chunk, "left")
    return joined.select(
        *chunked.columns,
        *[
            _combine(kind, F.col(f"_k_{n}"), F.col(f"_l_{n}")).alias(n)
            for n, (kind, _, _) in exprs.items()
        ],
        *([row_number] if row_number else []),
    )


def drop_chunks(df: DataFrame) -> DataFrame:
    return df.drop("_bucket", "_part")
