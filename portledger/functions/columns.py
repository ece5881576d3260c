"""Scalar column helpers: cleaning, parsing, formatting and identity.

Every helper maps a Column to a Column and stays in generated JVM code.
Missing input gives NULL (or the named default), never zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

NEW_YORK = "America/New_York"

# The text meaning "unconfirmed", and the identity patterns.
UNCONFIRMED = "待确认"
EVENT_ID_PATTERN = r"^[A-Za-z0-9._:-]{6,160}$"
BAR_ID_PATTERN = r"^[A-Za-z0-9._:-]{6,200}$"
TICKER_PATTERN = r"^[A-Z][A-Z0-9.-]{0,9}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
AWARE_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"

QTY = "decimal(20,8)"


def text(c: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def known_text(c: Column) -> Column:
    """Trimmed text; blank and the unconfirmed marker become NULL."""
    return F.nullif(text(c), F.lit(UNCONFIRMED))


def clean_ticker(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def safe_float(c: Column, default: float = 0.0) -> Column:
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(value), F.lit(default)).otherwise(F.coalesce(value, F.lit(default)))


def optional_float(c: Column) -> Column:
    value = known_text(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def clean_text(c: Column, default: str) -> Column:
    return F.coalesce(text(c), F.lit(default))


def _finite(c: Column) -> Column:
    value = c.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def fmt_num(c: Column, digits: int = 2) -> Column:
    return F.when(_finite(c), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise("NA")


def fmt_pct(c: Column, digits: int = 1) -> Column:
    return F.when(_finite(c), F.format_string(f"%.{digits}f%%", c.cast("double"))).otherwise("NA")


def fmt_money(c: Column) -> Column:
    return F.when(_finite(c), F.format_string("$%,.2f", c.cast("double"))).otherwise("NA")


def fmt_outcome(c: Column) -> Column:
    """Eight decimals, empty text where there is no finite value."""
    return F.when(_finite(c), F.format_string("%.8f", c.cast("double"))).otherwise("")


def parse_decimal(c: Column, *, allow_zero: bool) -> Column:
    """Decimal text; NULL when malformed or when the sign rule is broken."""
    value = F.trim(c.cast("string")).try_cast(QTY)
    return F.when(value >= 0 if allow_zero else value > 0, value)


def decimal_text(c: Column) -> Column:
    """Round to eight places and drop the trailing zeros of the fraction only."""
    fixed = F.round(c, 8).cast("decimal(38,8)").cast("string")
    return F.when(
        fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")
    ).otherwise(fixed)


def parse_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def parse_aware_time(c: Column) -> Column:
    """ISO text that names its offset, as an instant; naive text is invalid."""
    raw = F.trim(c.cast("string"))
    return F.when(raw.rlike(AWARE_TIME_PATTERN), raw.try_cast("timestamp"))


def iso_date(c: Column) -> Column:
    raw = known_text(c)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10).try_cast("date"))


def session_date(instant: Column, zone: str = NEW_YORK) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def minute_of_day(instant: Column, zone: str = NEW_YORK) -> Column:
    local = F.from_utc_timestamp(instant, zone)
    return F.hour(local) * 60 + F.minute(local)


def market_phase(instant: Column, zone: str = NEW_YORK) -> Column:
    minute = minute_of_day(instant, zone)
    return (
        F.when((minute >= 240) & (minute < 570), "PRE_MARKET")
        .when((minute >= 570) & (minute < 960), "REGULAR")
        .when((minute >= 960) & (minute < 1200), "AFTER_HOURS")
        .otherwise("CLOSED")
    )


def sender_address(c: Column) -> Column:
    """The address inside angle brackets if there is one, in lower case."""
    inner = F.regexp_extract(c, r"<([^<>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(c)))


def valid_event_id(c: Column) -> Column:
    return F.coalesce(c.rlike(EVENT_ID_PATTERN), F.lit(False))


def valid_ticker(c: Column) -> Column:
    return F.coalesce(c.rlike(TICKER_PATTERN), F.lit(False))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any of a configured list of patterns."""
    if not patterns:
        return F.lit(False)
    found = [F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False)) for pattern in patterns]
    return reduce(lambda left, right: left | right, found)


def alias_ticker(c: Column, aliases: Mapping[str, str]) -> Column:
    """Rewrite through a configured alias map; unknown tickers stay themselves."""
    if not aliases:
        return c
    pairs = [F.lit(part.strip().upper()) for item in aliases.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def canonical_json(c: Column) -> Column:
    """Compact JSON with the keys sorted at every level."""
    return F.to_json(F.parse_json(c))


def stable_index_id(batch_id: Column, message_id: Column, status: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", batch_id, message_id, status), 256)
    return F.concat(F.lit("idx-"), F.substring(digest, 1, 24))


# The fields that make two broker events the same event.
SIGNATURE_FIELDS = (
    "source_account",
    "event_type",
    "status",
    "side",
    "ticker",
    "account_ref",
    "quantity",
    "price",
    "fees",
    "currency",
    "trade_time",
    "trade_time_source",
    "affects_position",
    "parse_confidence",
)


def event_signature(columns: Sequence[str], fields: Sequence[str] = SIGNATURE_FIELDS) -> Column:
    """Digest of the trimmed identity fields; a field the table lacks counts as blank."""
    parts = [
        F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) if f in columns else F.lit("")
        for f in fields
    ]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def content_hash(columns: Sequence[str]) -> Column:
    """Digest of a whole row, NULL kept apart from the empty text."""
    fields = [F.col(c).cast("string").alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def ceil_to_minute(instant: Column) -> Column:
    start = F.date_trunc("minute", instant)
    return F.when(instant > start, start + F.expr("interval 1 minute")).otherwise(start)


def sentence(reasons: Sequence[Column], limit: int) -> Column:
    """The first ``limit`` reasons that apply, joined as one text."""
    present = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return F.concat_ws("; ", F.slice(present, 1, limit))
