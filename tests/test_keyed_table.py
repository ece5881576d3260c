"""The table of buckets that micro-batches read and rewrite."""

from pyspark.sql import functions as F

from portledger.streaming import ledgers as s
from portledger.streaming.state import KeyedTable

SCHEMA = "k string, n long"


def add(table, spark, pairs, number):
    """Counts by key, as a batch would keep them."""
    rows = spark.createDataFrame(pairs, SCHEMA)
    known = table.around(rows, number).withColumnRenamed("n", "old")
    merged = known.join(rows, "k", "full").select("k", (F.coalesce("old", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
    table.put(spark.createDataFrame(merged.collect(), SCHEMA), number)


def content(table, spark, keys, number=99):
    rows = spark.createDataFrame([(k, 0) for k in keys], SCHEMA)
    return {r.k: r.n for r in table.around(rows, number).collect()}


def test_batches_again_and_a_table_read_anew(spark, tmp_path):
    keys = [f"k{i}" for i in range(40)]
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    add(table, spark, [(k, 1) for k in keys], 0)
    add(table, spark, [("k3", 5), ("new", 7)], 1)
    want = {k: 1 for k in keys} | {"k3": 6, "new": 7}
    assert content(table, spark, [*keys, "new"]) == want
    # A batch that is run again after a failure reads what it read before.
    add(table, spark, [("k3", 5), ("new", 7)], 1)
    assert content(table, spark, [*keys, "new"]) == want
    assert content(table, spark, ["k3"], 1)["k3"] == 1
    # Buckets that a batch doesn't touch stay where they were written.
    assert sorted({n for numbers in table.written.values() for n in numbers[-1:]}) == [0, 1]
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    assert again.written == table.written and content(again, spark, [*keys, "new"]) == want
    assert content(table, spark, ["k3"]).keys() < want.keys()


LOG = "ticker string, event_id string, event_type string, previous_state string, new_state string, occurred_at timestamp, pos long, seq long"


def test_events_are_judged_across_batches(spark):
    """A key's state and time go on from batch to batch, whatever batch its events fall into."""
    rows = [
        ("A", "CANDIDATE_ADDED", None, "WATCHING", None), ("B", "STATE_CHANGED", "WATCHING", "PAUSED", "NO_SUCH_CANDIDATE"),
        ("A", "STATE_CHANGED", "WATCHING", "NEAR_TRIGGER", None), ("A", "STATE_CHANGED", "WATCHING", "PAUSED", "PREVIOUS_STATE_MISMATCH"),
        ("C", "CANDIDATE_ADDED", None, "RESEARCH_QUEUE", None), ("C", "STATE_CHANGED", "RESEARCH_QUEUE", "OPEN_CANDIDATE", "ILLEGAL_TRANSITION"),
        ("A", "CANDIDATE_ADDED", None, "WATCHING", "ALREADY_EXISTS"), ("C", "CANDIDATE_REVIEWED", "OPEN_CANDIDATE", None, None),
        ("C", "CANDIDATE_REVIEWED", None, "WATCHING", "STATE_CHANGED_BY_OTHER_EVENT"), ("B", "CANDIDATE_ADDED", None, "WATCHING", "ALREADY_EXISTS"),
    ]
    log = spark.createDataFrame([(t, f"e{i}", kind, old, new, None, i, i) for i, (t, kind, old, new, _) in enumerate(rows)], LOG)
    log = log.withColumn("occurred_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    for steps in (1, 3, 5):
        got = {r.event_id: r.rule for r in s.live_candidates(log, f"log{steps}", steps).collect()}
        assert got == {f"e{i}": row[-1] for i, row in enumerate(rows)}
