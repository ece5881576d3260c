"""Run Spark queries next to their SQL in DuckDB and compare the full results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """Return (ok, message)."""
    df = query(spark, sf_dir)
    left_cols, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(left)} rows (no SQL)"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    right_cols, right = _rows(names, rel.fetchall())
    if left_cols != right_cols:
        return False, f"columns differ: {left_cols} vs {right_cols}"
    if left == right:
        return True, f"{len(left)} rows"
    lefts, rights = set(left), set(right)
    only_left = [r for r in left if r not in rights][:3]
    only_right = [r for r in right if r not in lefts][:3]
    return False, (
        f"{len(left)} vs {len(right)} rows; cols {left_cols}\n   spark {only_left}\n   sql   {only_right}"
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from portledger.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, query, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
