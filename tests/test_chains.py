"""Walks over links that are shortened first reach the same nodes by as many hops."""

import random

import pytest
from pyspark.sql import functions as F

from portledger.operators import chains
from portledger.plans.files import generations

LINKS = "node string, next string"


def walked(links, heads):
    after, found = {}, []
    for node, follower in links:
        if follower is not None:
            after.setdefault(node, []).append(follower)
    end = 1 << sum(map(len, after.values())).bit_length()
    for head in heads:
        at, hops = [head], 0
        while at and hops < end:
            found += [(head, node, hops) for node in at]
            at, hops = [b for a in at if a is not None for b in after.get(a, [])], hops + 1
    return sorted(found, key=str)


@pytest.mark.parametrize(("few", "small"), [(0, 40), (chains.FEW, 10)])
def test_shortened_walks_equal_plain_ones(spark, monkeypatch, few, small):
    """Trees, chains, cycles, a link to itself, forks, repeated links and heads, nulls; nodes that are structs."""
    rng = random.Random(9)
    links = [(f"t{n}", f"t{rng.randrange(max(0, n - 6), n)}") for n in range(1, 90)]
    links += [(f"c{n}", f"c{(n + 1) % 7}") for n in range(7)] + [("s", "s"), ("u", "c3"), ("t0", None), (None, "t5")]
    links += [("f1", "f2"), ("f1", "f3"), ("f2", "f4"), ("f3", "f4"), ("f4", "f5"), ("f4", "f5"), ("f0", "f1"), ("f5", "t80")]
    heads = ["t89", "t88", "t70", "t70", "t3", "c2", "u", "s", "f0", "f3", "nowhere", None]
    monkeypatch.setattr(chains, "FEW", few)
    monkeypatch.setattr(chains, "SMALL", small, raising=False)
    node = F.when(F.col("node").isNotNull(), F.struct("node"))
    follower = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("node")))
    frame = spark.createDataFrame(links, LINKS).select(node.alias("node"), follower.alias("next"))
    starts = spark.createDataFrame([(h,) for h in heads], "node string").select(node.alias("node"))
    got = chains.walk(frame, starts).select("head.node", F.col("node.node").alias("at"), "hops")
    assert sorted(map(tuple, got.collect()), key=str) == walked(links, heads)


def test_links_no_head_reaches_are_not_doubled(spark, monkeypatch):
    written, write = [], chains.staged

    def counted(df, name):
        table = write(df, name)
        written.append(table.count() if "jumps" in name else 0)
        return table

    monkeypatch.setattr(chains, "staged", counted)
    monkeypatch.setattr(chains, "SMALL", 100, raising=False)
    links = spark.range(4000).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    reached = chains.walk(links, spark.range(3400, 3401).select(F.col("id").alias("node")))
    assert sorted(map(tuple, reached.select("node", "hops").collect())) == [(3400 + n, n) for n in range(601)]
    assert sum(written) < 6 * 4000


def test_generations_are_written_once_and_narrow(spark, tmp_path):
    """Orders of no account are numbered through, however far their keys lie apart."""
    orders = spark.range(40).select((F.col("id") * 400_000).alias("o_orderkey"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("o_custkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows, newest = generations(spark, str(tmp_path))
    assert {(r.account, r.transaction_id) for r in newest.collect()} == {("A0", "A0-10"), ("A1", "A1-20"), (None, "10")}
    assert rows.select("transaction_id").distinct().count() == 40
    assert spark.read.parquet(rows.inputFiles()[0].rpartition("/")[0]).columns == ["account", "o_orderkey", "n"]
