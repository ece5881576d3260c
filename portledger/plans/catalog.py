"""All registered plans."""

from portledger.plans import (  # noqa: F401 - importing registers the plans
    files,
    ledgers,
    prices,
    reviews,
    scoring,
    screening,
    streams,
)
from portledger.plans.registry import PLANS, SQL  # noqa: F401
