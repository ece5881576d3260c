"""Plans over files and text: scans, sinks, audits, rewrites, column helpers, lineage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from portledger.functions import columns as c
from portledger.operators import audit, ledger, metrics
from portledger.plans.fixtures import BAR_COLUMNS, fx_bars, fx_benchmarks, fx_broker, fx_raw_minutes, fx_snapshots, table
from portledger.plans.registry import plan, rounded
from portledger.session import scratch_path
from portledger.sources import readers, writers
from portledger.sources.staging import staged


def _as_csv(df, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@plan(
    "a1_scan_csv_contract",
    """SELECT seq, account_ref, event_type FROM (SELECT i AS seq, account_ref, CASE WHEN event_type = 'TRADE' THEN 'trade' ELSE event_type END AS event_type FROM fx_broker)""",
    uses=("fx_broker",),
)
def scan_csv_contract(spark, sf_dir):
    path = _as_csv(fx_broker(spark, sf_dir).select("seq", "account_ref", "event_type", "status"), "events-csv")
    rows = readers.scan_csv(spark, path, ["seq", "account_ref", "event_type"])
    return rows.select(F.col("seq").try_cast("long").alias("seq"), "account_ref", "event_type")


@plan(
    "a2_scan_bars",
    """SELECT bar_id, ticker, close, epoch(bar_at)::BIGINT AS bar_epoch FROM fx_raw_minutes""",
    uses=("fx_raw_minutes",),
)
def scan_bars(spark, sf_dir):
    bars = fx_raw_minutes(spark, sf_dir).select(*BAR_COLUMNS)
    aware = [F.date_format(n, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(n) if n in ("bar_at", "collected_at") else F.col(n) for n in BAR_COLUMNS]
    path = _as_csv(bars.select(*aware), "bars-csv")
    rows = readers.scan_csv(spark, path, BAR_COLUMNS, exact=True)
    return rows.select(
        "bar_id", "ticker", F.col("close").try_cast("double").alias("close"),
        F.unix_seconds(c.parse_aware_time(F.col("bar_at"))).alias("bar_epoch"),
    )


@plan(
    "a3_scan_table_optional",
    """SELECT ticker, count(*) AS days FROM fx_snapshots GROUP BY 1""",
    uses=("fx_snapshots",),
)
def scan_table_optional(spark, sf_dir):
    """An existing table and a missing one read through the same door."""
    rows = fx_snapshots(spark, sf_dir).select("ticker", "snapshot_date")
    schema = StructType([StructField(n, StringType()) for n in ("ticker", "snapshot_date")])
    found = readers.scan_optional(spark, _as_csv(rows, "snapshots-csv"), schema)
    missing = readers.scan_optional(spark, scratch_path(spark, "not-there"), schema)
    return found.unionByName(missing).groupBy("ticker").agg(F.count(F.lit(1)).alias("days"))


@plan(
    "a4_scan_event_log",
    """SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS good, count(*) FILTER (WHERE event_id % 50 = 0) AS bad,
              CAST(sum(CASE WHEN event_id % 50 <> 0 THEN event_id ELSE 0 END) AS BIGINT) AS id_sum FROM events""",
)
def scan_event_log(spark, sf_dir):
    """JSON lines with blanks and broken lines: the broken ones come back as text."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    whole = F.to_json(F.struct("event_id", "event_type"))
    broken = F.concat(F.lit("{broken "), F.col("event_id").cast("string"))
    path = scratch_path(spark, "log-jsonl")
    events.select(F.when(F.col("event_id") % 50 == 0, broken).otherwise(whole).alias("value")).write.text(path)
    schema = StructType([StructField("event_id", StringType()), StructField("event_type", StringType())])
    log = readers.scan_jsonl(spark, path, schema)
    bad = F.col(readers.BAD).isNotNull()
    return staged(log, "log").agg(
        F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"),
        F.coalesce(F.sum(F.when(~bad, F.col("event_id").try_cast("long"))), F.lit(0)).alias("id_sum"),
    )


@plan(
    "a4_bad_log_lines",
    """SELECT part, 2 * n - 1 AS line, '{broken ' || event_id AS text, true AS bad
       FROM (SELECT event_id, event_id % 3 AS part, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS n FROM events)
       WHERE event_id % 50 = 0""",
)
def bad_log_lines(spark, sf_dir):
    """Three log files with a blank line after each entry; the broken lines with their numbers."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    whole = F.to_json(F.struct("event_id", "event_type"))
    broken = F.concat(F.lit("{broken "), F.col("event_id").cast("string"))
    path = scratch_path(spark, "log-lines")
    lines = events.select(
        (F.col("event_id") % 3).alias("part"), "event_id",
        F.concat(F.when(F.col("event_id") % 50 == 0, broken).otherwise(whole), F.lit("\n")).alias("value"),
    )
    # One file a part, in order: the fixture's own.
    lines = lines.repartition("part").sortWithinPartitions("part", "event_id")
    lines.select("part", "value").write.partitionBy("part").text(path)
    schema = StructType([StructField("event_id", StringType()), StructField("event_type", StringType())])
    found = readers.bad_lines(readers.scan_numbered_jsonl(spark, path, schema))
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return found.select(part.alias("part"), "line", "text", F.lit(True).alias("bad"))


@plan(
    "a7_ohlcv_wide_to_long",
    """SELECT CAST(session_date AS VARCHAR) AS session_date, ticker, close, volume FROM fx_bars
       UNION ALL SELECT CAST(session_date AS VARCHAR), ticker, close, volume FROM fx_benchmarks""",
    uses=("fx_bars", "fx_benchmarks"),
)
def wide_to_long(spark, sf_dir):
    """Every ticker, stocks and benchmarks, eight to a wide row; the rows of one session differ in ``band``."""
    columns = ["ticker", "session_date", "close", "volume"]
    bars = fx_bars(spark, sf_dir).select(*columns).unionByName(fx_benchmarks(spark, sf_dir).select(*columns))
    bars = staged(bars, "bars")
    # One row a listed security.
    names = bars.select("ticker").distinct().withColumn("_n", F.row_number().over(Window.orderBy("ticker")) - 1)
    names = staged(names, "tickers")
    slots = [f"S{i}" for i in range(8)]
    numbered = bars.join(names, "ticker").withColumn("_slot", F.concat(F.lit("S"), (F.col("_n") % 8).cast("string")))
    wide = numbered.groupBy(F.struct("session_date", F.floor(F.col("_n") / 8).alias("band")).alias("session_date")).agg(
        *[
            F.max(F.when(F.col("_slot") == t, F.col(f))).alias(f"{t}|{f.title()}")
            for t in slots
            for f in ("close", "volume")
        ]
    )
    long = metrics.ohlcv_wide_to_long(wide, field_first=False)
    long = long.withColumn("_n", (F.col("session_date.band") * 8 + F.substring("ticker", 2, 1).cast("long")).cast("int"))
    return long.drop("ticker").join(names, "_n").select(
        F.col("session_date.session_date").cast("string").alias("session_date"), "ticker", "close", "volume"
    )


@plan(
    "a9_snapshot_upsert",
    """SELECT snapshot_date, count(*) AS rows, CAST(sum(CAST(CASE WHEN snapshot_date >= '2001-01-01' THEN market_value * 2 ELSE market_value END AS DECIMAL(18, 4))) AS DOUBLE) AS total
       FROM fx_snapshots GROUP BY 1""",
    uses=("fx_snapshots",),
)
def snapshot_upsert(spark, sf_dir):
    """Two writes to one table partitioned by month; the second replaces only its own months."""
    rows = fx_snapshots(spark, sf_dir).withColumn("month", F.substring(F.col("snapshot_date").cast("string"), 1, 7))
    path = scratch_path(spark, "snapshots")
    writers.upsert_slices(rows, path, "month")
    newer = rows.filter(F.col("snapshot_date") >= "2001-01-01")
    writers.upsert_slices(newer.withColumn("market_value", F.col("market_value") * 2), path, "month")
    schema = "account_ref string, ticker string, shares double, market_value double, snapshot_date string, month string"
    return spark.read.schema(schema).parquet(path).groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("market_value").cast("decimal(18,4)")).cast("double").alias("total")
    )


@plan(
    "a11_outcome_sink",
    """SELECT account_ref, ticker, snapshot_date, round(market_value, 4) AS market_value FROM fx_snapshots""",
    uses=("fx_snapshots",),
)
def outcome_sink(spark, sf_dir):
    rows = fx_snapshots(spark, sf_dir).select("account_ref", "ticker", "snapshot_date", F.round("market_value", 4).alias("market_value"))
    path = scratch_path(spark, "outcomes")
    writers.write_sorted(rows, path, "account_ref", "snapshot_date", "ticker")
    return spark.read.schema(rows.schema).parquet(path)


@plan(
    "a12_artifact_hash_audit",
    """SELECT 'doc' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 'CHANGED' WHEN doc_id % 10 = 1 THEN 'EXTRA' ELSE 'MISSING' END AS problem
       FROM documents WHERE doc_id % 10 IN (0, 1, 2)""",
)
def artifact_hash_audit(spark, sf_dir):
    """Content hashes of all documents against a manifest with planted differences."""
    docs = table(spark, sf_dir, "documents")
    i, name = F.col("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name")
    found = docs.filter(i % 10 != 2).select(name, F.sha2("text", 256).alias("sha256"))
    wanted = F.when(i % 10 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    manifest = docs.filter(i % 10 != 1).select(name, wanted.alias("sha256"))
    return audit.manifest_audit(manifest, found)


@plan(
    "a12_file_hash_audit",
    """SELECT CAST(doc_id // 500 AS BIGINT) AS bucket, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
              sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""",
)
def file_hash_audit(spark, sf_dir):
    """A file for every 500 documents, re-hashed from disk."""
    docs = table(spark, sf_dir, "documents").withColumn("bucket", F.floor(F.col("doc_id") / 500))
    path = scratch_path(spark, "files")
    ordered = docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text")
    ordered.write.partitionBy("bucket").text(path, lineSep="\n")
    files = audit.file_hashes(spark, path).filter(F.col("name").contains("/part-"))
    bucket = F.regexp_extract("name", r"bucket=(\d+)", 1).cast("long").alias("bucket")
    return files.select(bucket, F.col("length").alias("bytes"), "sha256")


HEX = "coalesce(sha256({0}), 'null')"


@plan(
    "a13_input_fingerprint",
    f"""SELECT sha256('version=1' || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS input_sha256, CAST(sum(n) AS BIGINT) AS input_rows
        FROM (SELECT count(*) AS n, b || '|' || count(*) || '|' || sum(p0) || '|' || sum(p1) || '|' || sum(p2) || '|' || sum(p3) || '|' || sum(p4) AS line
              FROM (SELECT ('0x' || substr(h, 61, 4))::BIGINT % 4096 AS b, {', '.join(f"('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT AS p{i}" for i in range(5))}
                    FROM (SELECT sha256({HEX.format('doc_id::VARCHAR')} || {HEX.format('lang')} || {HEX.format('n_chars::VARCHAR')} || {HEX.format('source')} || {HEX.format('text')}) AS h FROM documents))
              GROUP BY b)""",
)
def input_fingerprint(spark, sf_dir):
    return audit.fingerprint(table(spark, sf_dir, "documents"), "version=1")


@plan(
    "b_columns",
    """SELECT event_id AS seq, 'T' || (event_id % 7) AS ticker, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS safe,
              CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL ELSE value END AS optional,
              CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_type END AS clean,
              CASE WHEN event_id % 11 = 0 THEN 'NA' ELSE printf('%.1f%%', round(value, 1)) END AS pct,
              CASE WHEN event_id % 2 = 0 THEN 'id' || event_id || '@example.com' ELSE 'id' || event_id || '@example.com' END AS sender,
              event_id % 3 = 0 AS flag, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) END AS aware,
              CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS ny_date,
              CASE WHEN hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) BETWEEN 240 AND 569 THEN 'PRE_MARKET' WHEN hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) BETWEEN 570 AND 959 THEN 'REGULAR'
                   WHEN hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) BETWEEN 960 AND 1199 THEN 'AFTER_HOURS' ELSE 'CLOSED' END AS phase,
              CASE WHEN ts > date_trunc('minute', ts) THEN epoch(date_trunc('minute', ts))::BIGINT + 60 ELSE epoch(ts)::BIGINT END AS next_minute,
              'idx-' || substr(sha256('b|' || event_id || '|' || event_type), 1, 24) AS index_id,
              '{"a":' || event_id || ',"b":{"c":1,"d":2}}' AS canonical,
              regexp_replace(CAST(CAST(value AS DECIMAL(20,8)) AS VARCHAR), '\\.?0+$', '') AS qty,
              event_id % 13 <> 0 AS id_ok, CASE WHEN event_id % 7 = 0 THEN 'NEW' ELSE 'T' || (event_id % 7) END AS alias,
              CASE WHEN event_id % 6 = 0 THEN 'EVEN; THIRD' WHEN event_id % 2 = 0 THEN 'EVEN' WHEN event_id % 3 = 0 THEN 'THIRD' ELSE '' END AS reasons
       FROM events""",
)
def column_helpers(spark, sf_dir):
    """Every column helper over every event, in one projection."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    n = i.cast("string")
    ticker = F.concat(F.lit(" t"), (i % 7).cast("string"), F.lit(" "))
    raw = F.when(i % 5 == 0, "n/a").when(i % 3 == 0, c.UNCONFIRMED).otherwise(F.col("value").cast("string"))
    safe_raw = F.when(i % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    infinite = F.when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    address = F.concat(F.lit("ID"), n, F.lit("@Example.com"))
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    payload = F.concat(F.lit('{"b": {"d": 2, "c": 1}, "a": '), n, F.lit("}"))
    cleaned = c.clean_ticker(ticker)
    return table(spark, sf_dir, "events").select(
        i.alias("seq"),
        cleaned.alias("ticker"),
        c.safe_float(safe_raw).alias("safe"),
        c.optional_float(raw).alias("optional"),
        c.clean_text(F.when(i % 4 == 0, "  ").otherwise(F.col("event_type")), "none").alias("clean"),
        c.fmt_pct(infinite).alias("pct"),
        c.sender_address(F.when(i % 2 == 0, F.concat(F.lit("Name <"), address, F.lit(">"))).otherwise(address)).alias("sender"),
        F.coalesce(c.parse_bool(F.when(i % 3 == 0, " Yes").otherwise("0")), F.lit(False)).alias("flag"),
        F.unix_micros(c.parse_aware_time(F.when(i % 2 == 0, F.concat(stamp, F.lit("+00:00"))).otherwise(stamp))).alias("aware"),
        c.session_date(ts).cast("string").alias("ny_date"),
        c.market_phase(ts).alias("phase"),
        F.unix_seconds(c.ceil_to_minute(ts)).alias("next_minute"),
        c.stable_index_id(F.lit("b"), n, F.col("event_type")).alias("index_id"),
        c.canonical_json(payload).alias("canonical"),
        c.decimal_text(F.col("value").cast("decimal(20,8)")).alias("qty"),
        c.valid_event_id(F.concat(F.when(i % 13 == 0, "bad id ").otherwise("event-"), n)).alias("id_ok"),
        c.alias_ticker(cleaned, {"t0": "new"}).alias("alias"),
        c.sentence([F.when(i % 2 == 0, "EVEN"), F.when(i % 3 == 0, "THIRD")], 3).alias("reasons"),
    )


@plan(
    "b_formats",
    """SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'NA' ELSE printf('%.2f', value) END AS num,
              CASE WHEN event_id % 11 = 0 THEN 'NA' ELSE '$' || format('{:,.2f}', value) END AS money,
              CASE WHEN event_id % 11 = 0 THEN '' ELSE printf('%.8f', value) END AS outcome,
              CASE WHEN event_id % 3 = 1 AND event_id % 7 <> 0 THEN CAST(event_id % 7 AS DOUBLE) + 0.25 WHEN event_id % 3 = 1 THEN 0.25 END AS quantity,
              CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN CAST(event_id % 7 AS DOUBLE) + 0.25 END AS fees,
              CASE WHEN event_id % 4 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN event_id % 4 = 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day,
              event_id % 5 IN (0, 3) AS ticker_ok
       FROM events""",
)
def column_formats(spark, sf_dir):
    """Numbers as text, decimals under a sign rule, dates and tickers of every event."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    infinite = F.when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    # Zero, a quantity with blanks around it, or one that is negative or no number.
    amount = F.when(i % 3 == 0, "0").when(i % 3 == 1, F.concat(F.lit(" "), (i % 7).cast("string"), F.lit(".25 "))).otherwise(
        F.when(i % 2 == 0, "-1").otherwise("1,5")
    )
    day = F.date_format(ts, "yyyy-MM-dd")
    days = F.when(i % 4 == 0, day).when(i % 4 == 1, F.concat(day, F.lit("T10:00:00"))).when(i % 4 == 2, "2024-13-45")
    names = F.element_at(F.array(*[F.lit(t) for t in ("AB.C-1", "", "ABCDEFGHIJK", "T0", "1AB")]), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        i.alias("seq"), c.fmt_num(infinite).alias("num"), c.fmt_money(infinite).alias("money"), c.fmt_outcome(infinite).alias("outcome"),
        c.parse_decimal(amount, allow_zero=False).cast("double").alias("quantity"),
        c.parse_decimal(amount, allow_zero=True).cast("double").alias("fees"),
        c.iso_date(days).cast("string").alias("day"), c.valid_ticker(names).alias("ticker_ok"),
    )


@plan(
    "b19_event_signature",
    """SELECT count(*) AS events, count(DISTINCT (lower(trim(source_account)), event_type, status, account_ref, ticker, trade_time, proxy, affects, confirmed)) AS signatures FROM fx_broker""",
    uses=("fx_broker",),
)
def event_signature(spark, sf_dir):
    rows = fx_broker(spark, sf_dir)
    return rows.select(ledger.signature_of(rows).alias("s")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("s").alias("signatures")
    )


def _scan_sql() -> str:
    parts = [
        f"SELECT doc_id, '{label}' AS pattern, CAST(len(regexp_extract_all(text, '{p}')) AS INT) AS hits FROM documents"
        for label, p in audit.FORBIDDEN_PATTERNS.items()
    ]
    mail = r"SELECT doc_id, 'any mailbox' AS pattern, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}')) AS INT) AS hits FROM documents"
    return "SELECT * FROM (" + " UNION ALL ".join([*parts, mail]) + ") WHERE hits > 0"


@plan("c15_pattern_scan", _scan_sql())
def pattern_scan(spark, sf_dir):
    patterns = {**audit.FORBIDDEN_PATTERNS, "any mailbox": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"}
    return audit.pattern_scan(table(spark, sf_dir, "documents"), patterns, key="doc_id", body="text")


PHRASES = {"the": "THE", "of the": "OF-THE", "and": "&", "le": "LE", "der": "DER"}


@plan(
    "c16_phrase_rewrite",
    """SELECT doc_id, sha256(t) AS digest, length(t) AS chars, regexp_matches(t, '[一-鿿]') AS residue FROM (
         SELECT doc_id, regexp_replace(regexp_replace(x, '(\\S)  +(\\S)', '\\1 \\2', 'g'), ' +(\\n|$)', '\\1', 'g') AS t FROM (
           SELECT doc_id, replace(replace(replace(replace(replace(text, 'of the', 'OF-THE'), 'the', 'THE'), 'and', '&'), 'der', 'DER'), 'le', 'LE') AS x FROM documents))""",
)
def phrase_rewrite(spark, sf_dir):
    body = audit.phrase_rewrite(F.col("text"), PHRASES)
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("chars"),
        audit.has_residue(F.col("t")).alias("residue"),
    )


@plan(
    "d16_generation_chain_lookup",
    """WITH RECURSIVE g AS (SELECT 'A' || (o_custkey % 50) || '-' || row_number() OVER w AS id, 'A' || (o_custkey % 50) || '-' || (row_number() OVER w - 1) AS parent,
             row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey % 50) AS m, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)),
       chain(head, id, parent, o_orderkey, hops) AS (SELECT id, id, parent, o_orderkey, 0 FROM g WHERE n = m
         UNION ALL SELECT c.head, g.id, g.parent, g.o_orderkey, c.hops + 1 FROM chain c JOIN g ON g.id = c.parent WHERE c.o_orderkey % 503 <> 0)
       SELECT head, id AS transaction_id, o_orderkey AS batch_id, hops FROM chain""",
)
def generation_chain(spark, sf_dir):
    """All generations of every account walked back; a link with a wrong hash ends the walk."""
    rows, newest = generations(spark, sf_dir)
    return audit.generation_chain(rows, newest)


def generations(spark, sf_dir):
    """Generations of every account, one an order, and each account's newest."""
    from portledger.operators.scans import Order, drop_chunks, running, with_chunks

    # Orders of no account are numbered as one account, too.
    account = F.coalesce(F.concat(F.lit("A"), (F.col("o_custkey") % 50).cast("string")), F.lit("")).alias("account")
    orders = table(spark, sf_dir, "orders").select(account, "o_orderkey")
    order = Order(("account",), "o_orderkey", "o_orderkey", width=1 << 18)
    numbered = drop_chunks(
        running(with_chunks(orders, order), order, {"n": ("sum", F.lit(1).cast("long"), True)})
    )
    # Written narrow: names and digests are made by what reads them.
    numbered = staged(numbered.withColumn("account", F.nullif("account", F.lit(""))), "generations")

    def name(number):
        return F.concat_ws("-", "account", number.cast("string"))

    def digest(number):
        return F.sha2(name(number), 256)

    n, broken = F.col("n"), F.col("o_orderkey") % 503 == 0
    rows = numbered.select(
        "account", "n", name(n).alias("transaction_id"), name(n - 1).alias("parent_id"),
        F.when(broken, "wrong").otherwise(digest(n - 1)).alias("parent_hash"), digest(n).alias("content_hash"),
        F.col("o_orderkey").alias("batch_id"),
    )
    return rows, rows.groupBy("account").agg(F.max_by("transaction_id", "n").alias("transaction_id"))


@plan(
    "d16_batch_lookup",
    """WITH RECURSIVE g AS (SELECT 'A' || (o_custkey % 50) || '-' || row_number() OVER w AS id, 'A' || (o_custkey % 50) || '-' || (row_number() OVER w - 1) AS parent,
             row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey % 50) AS m, o_orderkey, 'A' || (o_custkey % 50) AS account
             FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)),
       chain(head, id, parent, o_orderkey, hops) AS (SELECT id, id, parent, o_orderkey, 0 FROM g WHERE n = m
         UNION ALL SELECT c.head, g.id, g.parent, g.o_orderkey, c.hops + 1 FROM chain c JOIN g ON g.id = c.parent WHERE c.o_orderkey % 503 <> 0),
       wanted AS (SELECT h.id AS head, CASE WHEN g.o_orderkey % 7 = 0 THEN -g.o_orderkey ELSE g.o_orderkey END AS batch_id, g.o_orderkey % 5 = 0 AS other
                  FROM g JOIN g h ON h.account = g.account AND h.n = h.m)
       SELECT w.head, w.batch_id, CASE WHEN c.id IS NULL THEN 'NEW' WHEN other THEN 'CONFLICT' ELSE 'SAME' END AS found
       FROM wanted w LEFT JOIN chain c ON c.head = w.head AND c.o_orderkey = w.batch_id""",
)
def batch_lookup(spark, sf_dir):
    """Every order looked for among its account's generations: some ids are unknown, some contents differ."""
    rows, newest = generations(spark, sf_dir)
    content = F.sha2(F.col("batch_id").cast("string"), 256)
    rows = rows.withColumn("batch_hash", content)
    heads = staged(newest, "heads")
    wanted = rows.join(heads.withColumnRenamed("transaction_id", "head"), "account").select(
        "head",
        F.when(F.col("batch_id") % 7 == 0, -F.col("batch_id")).otherwise(F.col("batch_id")).alias("batch_id"),
        F.when(F.col("batch_id") % 5 == 0, "other").otherwise(F.col("batch_hash")).alias("batch_hash"),
    )
    return audit.find_batch(audit.generation_chain(rows, heads), rows, wanted).select("head", "batch_id", "found")
