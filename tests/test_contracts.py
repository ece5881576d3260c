"""Field contracts of nested documents, numbered log lines and broker fills, rule by rule."""

import json

import pytest
from pyspark.sql import types as T

from portledger.operators import contracts
from portledger.sources import readers

SCAN = {
    "started_at": "a", "completed_at": "b", "window_start": "c", "pagination_complete": True, "pages_fetched": 1,
    "terminal_next_page_token": "", "history_id_before": "1", "history_id_after": "2",
}
MESSAGE = {"source_message_id": "m1", "sender": "s", "subject": "x", "events": [], "processing_status": "IGNORED"}
BATCH = {
    "schema_version": 1, "run_id": "r", "batch_id": "b", "target_account": "A@b.c", "expected_parent_transaction_id": "t",
    "scan": SCAN, "messages": [MESSAGE],
}


def without(of, *names):
    return {k: v for k, v in of.items() if k not in names}


@pytest.mark.parametrize(
    ("document", "found"),
    [
        (BATCH, []),
        ([1], [("batch", "", "", "NOT_AN_OBJECT")]),
        (None, [("batch", "", "", "NOT_AN_OBJECT")]),
        ({**BATCH, "more": None}, [("batch", "", "more", "UNKNOWN_FIELD")]),
        ({**BATCH, "scan": without(SCAN, "window_start")}, [("scan", "", "window_start", "MISSING_FIELD")]),
        ({**BATCH, "scan": {**SCAN, "pages_fetched": "1"}}, [("scan", "", "pages_fetched", "WRONG_TYPE")]),
        ({**BATCH, "scan": {**SCAN, "pagination_complete": 1, "x": 2}}, [("scan", "", "pagination_complete", "WRONG_TYPE"), ("scan", "", "x", "UNKNOWN_FIELD")]),
        ({**BATCH, "messages": [MESSAGE, {**MESSAGE, "mood": {"a": [1]}}]}, [("message", "1", "mood", "UNKNOWN_FIELD")]),
        (
            {**BATCH, "messages": [{**MESSAGE, "events": [{"ticker": "T"}, {"ticker": "T", "venue": 1, "sender": "other", "subject": "x", "source_account": "a@B.c"}]}]},
            [("event", "0.1", "sender", "CONFLICTING_FIELD"), ("event", "0.1", "source_account", "CONFLICTING_FIELD"), ("event", "0.1", "venue", "UNKNOWN_FIELD")],
        ),
        (
            {**BATCH, "messages": [{**MESSAGE, "quarantine": {"reason": " ", "sender": "", "resolution_status": "OPEN", "z": 1}}]},
            [("quarantine", "0", "reason", "EMPTY_FIELD"), ("quarantine", "0", "z", "UNKNOWN_FIELD")],
        ),
        ({**BATCH, "messages": [{**MESSAGE, "quarantine": {}}]}, [("quarantine", "0", f, "EMPTY_FIELD") for f in ("reason", "resolution_status")]),
        ({**BATCH, "messages": "none", "scan": SCAN}, []),
    ],
)
def test_each_rule(spark, document, found):
    body = "{broken" if document is None else json.dumps(document)
    rows = spark.createDataFrame([("k", body)], "batch_id string, body string")
    documents = contracts.read_documents(rows, "body", "batch_id")
    got = contracts.batch_violations(documents, "batch_id", ("ticker", "sender", "subject", "source_account"), ("reason", "resolution_status", "sender"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(found)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files cut into many splits, blank lines, a last line without an end, an empty file."""
    want = []
    for name, count in (("a", 900), ("b", 1), ("c", 300)):
        lines = [f"{name}{i} " + "x" * (i % 40) if i % 7 else "" for i in range(count)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ("" if name == "c" else "\n"))
        want += [(name, i + 1, line) for i, line in enumerate(lines)]
    (tmp_path / "d.txt").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted((r.file.rpartition("/")[2][0], r.line, r.value) for r in got) == sorted(want)


def test_broken_lines_carry_their_place(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "1"}\n\n{"id": \nnot json\n{"id": "2"}\n')
    schema = T.StructType([T.StructField("id", T.StringType())])
    scanned = readers.scan_numbered_jsonl(spark, str(tmp_path), schema)
    assert sorted(r.id for r in scanned.filter("_bad_line is null").collect()) == ["1", "2"]
    assert sorted((r.line, r.text) for r in readers.bad_lines(scanned).collect()) == [(3, '{"id": '), (4, "not json")]
