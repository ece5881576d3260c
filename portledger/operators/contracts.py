"""Contracts of nested documents whose fields aren't known beforehand.

A document is read as VARIANT: a schema would drop the fields that a contract must refuse. Keys are listed level by
level with ``variant_explode``, without a shuffle, and each key or value that breaks the contract is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The fields of a scan batch, by level.
BATCH = (
    "schema_version", "run_id", "batch_id", "target_account", "expected_parent_transaction_id", "scan", "messages",
)
SCAN = (
    "started_at", "completed_at", "window_start", "pagination_complete", "pages_fetched", "terminal_next_page_token",
    "history_id_before", "history_id_after",
)
MESSAGE = (
    "source_message_id", "source_thread_id", "message_received_at", "sender", "subject", "content_hash",
    "parser_version", "lifecycle_type", "processing_status", "discovered_at", "processed_at", "events", "quarantine",
    "notes",
)
#: Fields that events and quarantine records take from their message; their own value may only repeat it.
DERIVED_EVENT = ("source_message_id", "source_thread_id", "sender", "subject", "content_hash", "parser_version")
DERIVED_QUARANTINE = ("source_message_id", "source_thread_id", "sender", "subject")

FOUND = ("level", "place", "field", "rule")


def read_documents(rows: DataFrame, body: str, keep: str) -> DataFrame:
    """``keep`` and doc, the JSON text of ``body`` as VARIANT; doc is NULL where the text is no JSON."""
    return rows.select(keep, F.try_parse_json(F.col(body)).alias("doc"))


def fields(rows: DataFrame, of: str, names: tuple[str, str, str] = ("pos", "key", "value")) -> DataFrame:
    """A row for each field or element of the VARIANT ``of``; other values have none."""
    pos, key, value = names
    listed = rows.sparkSession.tvf.variant_explode(F.col(of).outer()).toDF(pos, key, value)
    return rows.lateralJoin(listed)


def _part(doc: str, path: str) -> Column:
    return F.try_variant_get(F.col(doc), f"$.{path}", "variant")


def _text(doc: str, path: str) -> Column:
    return F.coalesce(F.trim(F.try_variant_get(F.col(doc), f"$.{path}", "string")), F.lit(""))


def _kind(doc: str, path: str) -> Column:
    """VARIANT's own name of a value's type, without its elements."""
    return F.regexp_extract(F.schema_of_variant(_part(doc, path)), r"^[A-Z]+", 0)


def _unknown(listed: DataFrame, keep: list[str], level: str, place: Column, allowed: tuple[str, ...]) -> DataFrame:
    return listed.filter(~F.col("key").isin(*allowed)).select(
        *keep, F.lit(level).alias("level"), place.alias("place"), F.col("key").alias("field"), F.lit("UNKNOWN_FIELD").alias("rule")
    )


def _conflicts(listed: DataFrame, keep: list[str], level: str, place: Column, derived: tuple[str, ...]) -> DataFrame:
    """Fields with a value of their own that differs from the message's."""
    own = F.coalesce(F.try_variant_get("value", "$", "string"), F.lit(""))
    account = F.when(F.col("key") == "source_account", F.lower(_text("doc", "target_account")))
    wanted = F.coalesce(account, *[F.when(F.col("key") == name, _text("message", name)) for name in derived])
    return listed.filter((own != "") & (own != wanted)).select(
        *keep, F.lit(level).alias("level"), place.alias("place"), F.col("key").alias("field"), F.lit("CONFLICTING_FIELD").alias("rule")
    )


def batch_violations(documents: DataFrame, key: str, event_fields: tuple[str, ...], quarantine_fields: tuple[str, ...]) -> DataFrame:
    """``key``, level, place, field and rule of everything in a batch that its contract doesn't know or lacks.

    ``documents`` has ``key`` and the VARIANT doc. ``place`` is the message's position, then the event's.
    """
    keep = [key]
    whole = F.coalesce(F.regexp_extract(F.schema_of_variant("doc"), r"^[A-Z]+", 0) == "OBJECT", F.lit(False))
    not_read, documents = documents.filter(~whole), documents.filter(whole)
    out = not_read.select(
        *keep, F.lit("batch").alias("level"), F.lit("").alias("place"), F.lit("").alias("field"), F.lit("NOT_AN_OBJECT").alias("rule")
    )
    out = out.unionByName(_unknown(fields(documents, "doc"), keep, "batch", F.lit(""), BATCH))

    scans = documents.select(*keep, _part("doc", "scan").alias("scan"), *[
        _kind("doc", f"scan.{name}").alias(f"_{name}") for name in ("pagination_complete", "pages_fetched")
    ])
    out = out.unionByName(_unknown(fields(scans, "scan"), keep, "scan", F.lit(""), SCAN))
    missing = F.array(*[F.when(F.try_variant_get("scan", f"$.{name}", "variant").isNull(), F.lit(name)) for name in SCAN])
    typed = F.array(
        F.when(F.col("_pagination_complete").isNotNull() & (F.col("_pagination_complete") != "BOOLEAN"), F.lit("pagination_complete")),
        F.when(F.col("_pages_fetched").isNotNull() & (F.col("_pages_fetched") != "BIGINT"), F.lit("pages_fetched")),
    )
    for rule, names in (("MISSING_FIELD", missing), ("WRONG_TYPE", typed)):
        each = scans.select(*keep, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("field"))
        out = out.unionByName(each.select(*keep, F.lit("scan").alias("level"), F.lit("").alias("place"), "field", F.lit(rule).alias("rule")))

    held = documents.select(*keep, "doc", _part("doc", "messages").alias("_messages"))
    messages = fields(held, "_messages", ("message_pos", "_none", "message")).drop("_none", "_messages")
    place = F.col("message_pos").cast("string")
    out = out.unionByName(_unknown(fields(messages, "message"), keep, "message", place, MESSAGE))

    events = messages.select("*", _part("message", "events").alias("_events"))
    events = fields(events, "_events", ("event_pos", "_none", "_event")).drop("_none", "_events")
    listed = fields(events, "_event")
    at = F.concat_ws(".", place, F.col("event_pos").cast("string"))
    out = out.unionByName(_unknown(listed, keep, "event", at, event_fields))
    out = out.unionByName(_conflicts(listed, keep, "event", at, DERIVED_EVENT))

    records = messages.select("*", _part("message", "quarantine").alias("_record"))
    listed = fields(records, "_record")
    out = out.unionByName(_unknown(listed, keep, "quarantine", place, quarantine_fields))
    out = out.unionByName(_conflicts(listed, keep, "quarantine", place, DERIVED_QUARANTINE))
    lacking = F.array(*[F.when(_text("_record", name) == "", F.lit(name)) for name in ("reason", "resolution_status")])
    lacking = records.filter(F.col("_record").isNotNull()).select(*keep, "message_pos", F.explode(F.filter(lacking, lambda n: n.isNotNull())).alias("field"))
    return out.unionByName(
        lacking.select(*keep, F.lit("quarantine").alias("level"), place.alias("place"), "field", F.lit("EMPTY_FIELD").alias("rule"))
    )
