"""Streaming twins of the ledger operators.

Deduplication, merging, cursor checks and replays of logs stay in Spark SQL: a micro-batch is judged by
the batch twins, which run on from one row a key in a table of buckets. Only positions carry Python state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from portledger.operators import positions as p
from portledger.operators.eventlog import STATE_EVENTS, candidate_rules, candidate_states, decision_history, decision_rules
from portledger.operators.ledger import row_digests, waterline_rules
from portledger.operators.skew import attach
from portledger.session import scratch_path
from portledger.sources.staging import staged
from portledger.streaming.state import KeyedTable


def dedup_by_id(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Replayed rows are no-ops while their id is inside the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


Drain = Callable[[DataFrame], None]


def into_table(df: DataFrame, name: str, shape: Callable[[DataFrame], DataFrame]) -> tuple[Drain, str]:
    """A drain that appends the shaped stream to one table; runs share one checkpoint."""
    path, marks = scratch_path(df.sparkSession, name), scratch_path(df.sparkSession, f"{name}-checkpoint")

    def drain(stream: DataFrame) -> None:
        query = (
            shape(stream).writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    return drain, path


def by_batch(df: DataFrame, name: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> Drain:
    """A drain that hands each micro-batch to ``handle``."""
    marks = scratch_path(df.sparkSession, f"{name}-checkpoint")

    def drain(stream: DataFrame) -> None:
        query = (
            stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", marks)
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    return drain


def feed(df: DataFrame, name: str, drain: Drain, steps: int = 3, path: str | None = None) -> None:
    """Let a table arrive in ``steps`` along ``seq`` (at ``path``), draining the stream after each arrival."""
    spark = df.sparkSession
    whole, path = staged(df, f"{name}-all"), path or scratch_path(spark, name)
    cuts = whole.approxQuantile("seq", [i / steps for i in range(1, steps)], 0.01) if steps > 1 else []
    step = sum((F.when(F.col("seq") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for number in range(steps):
        whole.filter(step == number).write.mode("append").parquet(path)
        drain(spark.readStream.schema(df.schema).parquet(path))


def merge_overlapping(df: DataFrame, name: str, columns: list[str], steps: int = 3) -> DataFrame:
    """Overlapping scans merged into one table: every batch appends only new rows.

    A batch is held against the digests in the buckets that its rows fall into, not against the table.
    """
    spark = df.sparkSession
    path, schema = scratch_path(spark, f"{name}-merged"), df.select(*columns).schema
    seen = KeyedTable(spark, scratch_path(spark, f"{name}-digests"), "_row string", ["_row"])

    def handle(batch: DataFrame, number: int) -> None:
        rows = staged(row_digests(batch, columns).dropDuplicates(["_row"]), f"{name}-batch")
        known = staged(seen.around(rows, number), f"{name}-known")
        fresh = rows.join(known, "_row", "left_anti")
        fresh.drop("_row").write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen.put(known.unionByName(fresh.select("_row")), number)

    feed(df, name, by_batch(df, name, handle), steps)
    return spark.read.schema(schema).parquet(path).select(*columns)


def visible_by_learn_time(stream: DataFrame, learn: str, event: str, as_of: str, delay: str = "1 day") -> DataFrame:
    """Counts per event day of what was learned by ``as_of``; lateness is judged on learn time only."""
    limit = F.lit(as_of).cast("timestamp")
    known = stream.withWatermark(learn, delay).filter((F.col(learn) <= limit) & (F.col(event) <= limit))
    return known.groupBy(F.to_date(event).alias("day")).agg(F.count(F.lit(1)).alias("known"))


def check_waterline(df: DataFrame, name: str, steps: int = 3) -> DataFrame:
    """Scan cursors checked batch by batch against the scans accepted before."""
    spark = df.sparkSession
    path, out = scratch_path(spark, f"{name}-seen"), scratch_path(spark, f"{name}-rules")
    schema = df.schema
    spark.createDataFrame([], schema).write.parquet(path)

    def handle(batch: DataFrame, _: int) -> None:
        seen = batch.sparkSession.read.schema(schema).parquet(path)
        fresh = staged(batch.join(seen.select("batch_id"), "batch_id", "left_anti"), f"{name}-batch")
        ruled = waterline_rules(seen.unionByName(fresh), ["scan_no"])
        ruled.join(fresh.select("batch_id"), "batch_id", "left_semi").select("batch_id", "rule").write.mode(
            "append"
        ).parquet(out)
        fresh.write.mode("append").parquet(path)

    feed(df, name, by_batch(df, name, handle), steps)
    return spark.read.schema("batch_id string, rule string").parquet(out)


# --- keyed replays --------------------------------------------------------------

CANDIDATE_OUT = "ticker string, event_id string, seq long, state string, rule string"
DECISION_OUT = "decision_id string, event_id string, seq long, rule string"
POSITION_OUT = "account_ref string, ticker string, step long, shares double, total_cost double, realised double, rule string"


def _rows(chunks: Iterator[pd.DataFrame], order: list[str]) -> Iterator[dict]:
    """The new rows of one key in ledger order; one micro-batch of one key."""
    frame = pd.concat(list(chunks)).sort_values(order)
    frame = frame.astype(object).where(frame.notna(), None)
    yield from frame.to_dict("records")


def _judged(df: DataFrame, name: str, key: str, schema: str, out: str, judge, after, steps: int) -> DataFrame:
    """Events of a log judged batch by batch against the few fields known of their key.

    ``judge`` gives the batch's events with ``rule``, from the events and one row a key; ``after`` gives those rows anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-judged")
    states = KeyedTable(spark, scratch_path(spark, f"{name}-states"), schema, [key])

    def handle(batch: DataFrame, number: int) -> None:
        rows = staged(batch, f"{name}-batch")
        known = staged(states.around(rows, number), f"{name}-known")
        found = judge(attach(rows, known, [key]))
        found.select(*[part.split()[0] for part in out.split(", ")]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        fresh = after(rows)
        merged = known.join(fresh, key, "full")
        fields = [part.split()[0] for part in schema.split(", ")][1:]
        states.put(merged.select(key, *[MERGES[f](F.col(f), F.col(f"new_{f}")).alias(f) for f in fields]), number)

    feed(df, name, by_batch(df, name, handle), steps)
    return spark.read.schema(out).parquet(path)


def _later(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def _more(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0).cast("long")) + F.coalesce(new, F.lit(0).cast("long"))


#: How the fields known of a key go on with those of a batch.
MERGES = {"state": _later, "_marker": _later, "latest": F.greatest, "created": _more, "intents": _more, "sent": _more}


def live_candidates(df: DataFrame, name: str, steps: int = 3) -> DataFrame:
    """The candidate funnel batch by batch: events of a batch run on from one state and one time per ticker.

    As in the batch twin, a refused change is still the state later events are judged by.
    """
    sets = F.col("event_type").isin(*STATE_EVENTS)

    def judge(rows: DataFrame) -> DataFrame:
        seen = candidate_states(rows)
        current = F.coalesce("current_state", "state")
        seen = seen.withColumn("current_state", current).withColumn("latest_before", F.greatest("latest_before", "latest"))
        return candidate_rules(seen).withColumn("state", F.when(sets, F.col("new_state")).otherwise(F.col("current_state")))

    def after(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ticker").agg(
            F.max_by("new_state", F.when(sets, F.struct("pos", "seq"))).alias("new_state"), F.max("occurred_at").alias("new_latest")
        )

    return _judged(df, name, "ticker", "ticker string, state string, latest timestamp", CANDIDATE_OUT, judge, after, steps)


def live_decisions(df: DataFrame, name: str, steps: int = 3) -> DataFrame:
    """The decision outbox batch by batch: three counts, a marker and a time per decision."""
    kind = F.col("event_type")

    def judge(rows: DataFrame) -> DataFrame:
        seen = decision_history(rows)
        for column, known in (("created_before", "created"), ("intents_before", "intents"), ("sent_before", "sent")):
            seen = seen.withColumn(column, _more(F.col(column), F.col(known)))
        seen = seen.withColumn("intent_marker", F.coalesce("intent_marker", "_marker"))
        return decision_rules(seen.withColumn("latest_before", F.greatest("latest_before", "latest")))

    def after(rows: DataFrame) -> DataFrame:
        intent = kind == "EMAIL_SEND_INTENT"
        return rows.groupBy("decision_id").agg(
            F.count_if(kind == "DECISION_CREATED").alias("new_created"), F.count_if(intent).alias("new_intents"),
            F.count_if(kind == "EMAIL_SENT").alias("new_sent"), F.max_by("marker", F.when(intent, F.struct("pos", "seq"))).alias("new__marker"),
            F.max("occurred_at").alias("new_latest"),
        )

    schema = "decision_id string, created long, intents long, sent long, _marker string, latest timestamp"
    return _judged(df, name, "decision_id", schema, DECISION_OUT, judge, after, steps)


def _position(key, chunks, group: GroupState) -> Iterator[pd.DataFrame]:
    shares, cost, realised, *latest, done, late = group.get if group.exists else (0.0, 0.0, 0.0, None, None, None, 0, False)
    out = []
    for row in _rows(chunks, ["pos", "item", "tie"]):
        rule, q, price, fees = None, row["quantity"], row["price"], row["fees"] or 0.0
        at = (row["pos"], row["item"], row["tie"])
        late = late or latest[0] is not None and at < tuple(latest)
        done += 1
        if late:  # from here on the key is replayed from the log of its fills
            out.append((*key, done, None, None, None, "LATE"))
            continue
        if row["side"] == "SELL" and q > shares:
            rule = "OVERSOLD"
        elif row["side"] == "SELL":
            average = cost / shares
            realised += q * (price - average) - fees
            shares -= q
            cost = cost - q * average if shares else 0.0
        else:
            shares, cost = shares + q, cost + q * price + fees
        latest = at
        out.append((*key, done, shares, cost, realised, rule))
    group.update((shares, cost, realised, *latest, done, late))
    yield pd.DataFrame(out, columns=["account_ref", "ticker", "step", "shares", "total_cost", "realised", "rule"])


def positions(stream: DataFrame) -> DataFrame:
    """Average-cost positions as keyed state; from its first late fill on, a key's fills are marked, not applied."""
    return stream.groupBy("account_ref", "ticker").applyInPandasWithState(
        _position, POSITION_OUT,
        "shares double, cost double, realised double, pos long, item long, tie long, done long, late boolean",
        "append", GroupStateTimeout.NoTimeout,
    )


LIVE = "account_ref string, ticker string, fills long, refused long, shares double, total_cost double, realised double"


def replayed(fills: DataFrame) -> DataFrame:
    """Positions from whole logs of fills, as the keyed state makes them from fills in order.

    The batch fold, for positions of any size; where a sell was more than was held, and is refused, what is held
    next depends on it, so these positions are folded fill by fill.
    """
    # Written as they come: what a replay derives from them is wider than they are.
    fills = staged(fills.select(*p.KEYS, "side", "quantity", "price", "fees", "pos", "item", "tie"), "replay-fills")
    rows = fills.select(
        *p.KEYS, "side", F.col("quantity").cast(p.BIG).alias("quantity"), "price", F.coalesce("fees", F.lit(0.0)).alias("fees"),
        "pos", F.col("item").alias("seq"), "tie", F.lit("TRADE").alias("event_type"), F.timestamp_micros("pos").alias("trade_time"),
        F.lit(None).cast("date").alias("entry_date"),
    ).withColumn("signed", F.when(F.col("side") == "SELL", -F.col("quantity")).otherwise(F.col("quantity")))
    folded = staged(p.fold(rows, order=p.Order(p.KEYS, "pos", "seq", 30 * p.DAY, ("tie", "signed", "price"))), "replay-folded")
    plain = folded.filter(~F.col("oversold")).select(
        *p.KEYS, F.col("applied").alias("fills"), F.lit(0).cast("long").alias("refused"), F.col("shares").cast("double").alias("shares"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), F.col("realised_pnl").alias("realised"),
    )
    packed = rows.join(folded.filter("oversold").select(*p.KEYS), list(p.KEYS), "left_semi").groupBy(*p.KEYS).agg(
        F.array_sort(F.collect_list(F.struct("pos", "seq", "tie", "side", F.col("quantity").cast("double").alias("q"), "price", "fees"))).alias("_f")
    )
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).cast("long").alias("refused"), zero.alias("shares"), zero.alias("total_cost"), zero.alias("realised"))

    def step(held, f):
        sell, left = f["side"] == "SELL", held["shares"] - f["q"]
        refused = sell & (left < 0)
        average = held["total_cost"] / F.nullif(held["shares"], zero)
        return F.struct(
            (held["refused"] + refused.cast("long")).alias("refused"),
            F.when(refused, held["shares"]).when(sell, left).otherwise(held["shares"] + f["q"]).alias("shares"),
            F.when(refused, held["total_cost"]).when(sell & (left == 0), zero).when(sell, held["total_cost"] - f["q"] * average)
            .otherwise(held["total_cost"] + f["q"] * f["price"] + f["fees"]).alias("total_cost"),
            F.when(sell & ~refused, held["realised"] + f["q"] * (f["price"] - average) - f["fees"]).otherwise(held["realised"]).alias("realised"),
        )

    one_by_one = packed.select(*p.KEYS, F.size("_f").cast("long").alias("fills"), F.aggregate("_f", start, step).alias("_e"))
    return plain.unionByName(one_by_one.select(*p.KEYS, "fills", "_e.*"))


def live_positions(df: DataFrame, name: str, steps: int = 3) -> DataFrame:
    """Positions of fills that arrive along ``seq`` in any order of their own times.

    Keys whose fills arrive in order are kept as state. Rows of a key from its first late fill on go to a part of
    the table of their own; each batch that brings some replays these keys from the log of all fills.
    """
    spark = df.sparkSession
    log, out, again = (scratch_path(spark, f"{name}{part}") for part in ("", "-applied", "-replayed"))
    applied = f"{POSITION_OUT}, late boolean"

    def handle(batch: DataFrame, number: int) -> None:
        # A batch replayed after a failure writes its own folders anew.
        session, folder = batch.sparkSession, f"{out}/batch={number}"
        rows = batch.withColumn("late", F.coalesce(F.col("rule") == "LATE", F.lit(False)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("late").parquet(folder)
        late = session.read.schema(applied).parquet(folder).filter("late")
        keys = staged(late.select(*p.KEYS).distinct(), f"{name}-late-keys")
        made = session.createDataFrame([], LIVE)
        if not keys.isEmpty():
            made = replayed(session.read.schema(df.schema).parquet(log).join(keys, list(p.KEYS), "left_semi"))
        made.write.mode("overwrite").parquet(f"{again}/batch={number}")

    drain = by_batch(df, name, handle)
    feed(df, name, lambda stream: drain(positions(stream)), steps, log)
    replays = spark.read.schema(f"{LIVE}, batch int").parquet(again).groupBy(*p.KEYS).agg(
        F.max_by(F.struct("fills", "refused", "shares", "total_cost", "realised"), "batch").alias("_e")
    )
    kept = spark.read.schema(f"{applied}, batch int").parquet(out).filter("not late").join(replays, list(p.KEYS), "left_anti").groupBy(*p.KEYS).agg(
        F.count(F.lit(1)).alias("fills"), F.count_if(F.col("rule") == "OVERSOLD").alias("refused"),
        F.max_by(F.struct("shares", "total_cost", "realised"), "step").alias("_e"),
    )
    return kept.select(*p.KEYS, "fills", "refused", "_e.*").unionByName(replays.select(*p.KEYS, "_e.*"))
