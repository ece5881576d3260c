"""The SQL twin of each registered plan."""

from portledger.plans.catalog import SQL  # noqa: F401
