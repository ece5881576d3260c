"""Registry of named query plans and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from portledger.plans.ctes import with_ctes

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
    """Register a plan; ``uses`` names the shared views its SQL reads."""

    def register(fn: Plan) -> Plan:
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql, uses)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so two engines that sum in other orders agree."""
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
