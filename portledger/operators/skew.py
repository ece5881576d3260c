"""Keeping hot groups apart.

One key may hold a third of all rows. ``hot_groups`` measures a table once, before a plan is built on it:
groups of more than ROWS rows are written down with the number of pieces to cut each into. The limit is a
fixed number of rows, so a piece never grows with the data. The list is a table; whether it is
broadcast is left to the planner, which sees its size. Where the list is empty it isn't joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from portledger.sources.staging import staged

#: Rows of one group that may meet in one task.
ROWS = 10_000
#: Salts of rows whose key is NULL; they match nothing, so they are only spread.
NULL_SALTS = 1024


def hot_groups(
    df: DataFrame, keys: Sequence[str], *, stats: Sequence[Column] = (), limit: int = ROWS
) -> DataFrame:
    """Groups of more than ``limit`` rows and ``_splits``, the pieces to cut each into.

    One pass, aggregated before the shuffle; rows with a NULL in a key are not counted.
    """
    known = df.filter(_complete(keys))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *stats)
    hot = counts.filter(F.col("_n") > limit)
    return staged(hot.withColumn("_splits", F.ceil(F.col("_n") / limit).cast("int")).drop("_n"), "hot-groups")


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    measured: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """Join one row per group onto ``rows``; hot groups are salted on both sides.

    ``how`` must keep or match left rows (``left``, ``inner``, ``left_semi`` or
    ``left_anti``), since only the group side is replicated. ``measured`` names a
    cheaper table with the same key values to look for hot groups in. Rows with
    a NULL key match nothing and are spread over all tasks. Exact copies of a
    row share a salt; a table of many copies is aggregated before it is joined.
    """
    keys = list(keys)
    hot = hot_groups((rows if measured is None else measured).select(*keys), keys, **limits)
    mixed = F.xxhash64(*rows.columns)
    spread = F.when(~_complete(keys), F.pmod(mixed, F.lit(NULL_SALTS)))
    if hot.isEmpty():
        left = rows.withColumn("_salt", spread.otherwise(0).cast("int"))
        return left.join(groups.withColumn("_salt", F.lit(0)), [*keys, "_salt"], how).drop("_salt")
    spread = spread.when(F.col("_splits").isNotNull(), F.pmod(mixed, F.col("_splits"))).otherwise(0)
    left = rows.join(hot, keys, "left").withColumn("_salt", spread.cast("int")).drop("_splits")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    right = (
        groups.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_splits")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
