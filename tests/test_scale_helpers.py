"""Chunked scans and salted joins give the plain result when everything is hot."""

import random

import pytest
from pyspark.sql import Window, functions as F

from portledger.operators.scans import Order, drop_chunks, running, with_chunks
from portledger.operators.skew import attach, hot_groups

HOT = {"limit": 7}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{rng.randrange(5)}"
        data.append((key, rng.randrange(12) * 10, i, rng.choice([None, 1, 2, -3])))
    return spark.createDataFrame(data, "k string, pos long, tie long, v long").cache()


@pytest.mark.parametrize("limits", [{}, HOT])
@pytest.mark.parametrize("width", [1, 25, 1000])
def test_running_equals_window(rows, limits, width):
    order = Order(("k",), "pos", "tie", width=width)
    got = drop_chunks(
        running(
            with_chunks(rows, order, **limits),
            order,
            {
                "s": ("sum", F.col("v"), True),
                "s0": ("sum", F.col("v"), False),
                "m": ("max", F.col("v"), True),
                "l": ("last", F.col("v"), False),
            },
        )
    )
    w = Window.partitionBy("k").orderBy("pos", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*",
        F.sum("v").over(upto).alias("s"),
        F.sum("v").over(before).alias("s0"),
        F.max("v").over(upto).alias("m"),
        F.last("v", True).over(before).alias("l"),
    )
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_chunks_are_cut_and_ordered(rows):
    order = Order(("k",), "pos", "tie", width=1000)
    cut = with_chunks(rows, order, **HOT)
    sizes = cut.groupBy("k", "_bucket", "_part").count().agg(F.max("count")).first()[0]
    assert sizes < rows.filter("k = 'hot'").count() / 3
    w = Window.partitionBy("k").orderBy("pos", "tie")
    back = cut.withColumn("p", F.lag("_part").over(w)).filter(F.col("p") > F.col("_part"))
    assert back.count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_equals_join(spark, rows, how):
    groups = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, g int")
    got = attach(rows, groups, ["k"], how=how, **HOT)
    want = rows.join(groups, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_groups_depend_on_rows_alone(rows):
    hot = hot_groups(rows, ["k"], limit=120)
    assert {(r["k"], r["_splits"]) for r in hot.collect()} == {("hot", 4)}
    assert hot_groups(rows, ["k"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_null_keys_match_nothing_and_are_spread(spark, how):
    rows = spark.range(300).selectExpr("if(id % 3 > 0, null, 'k') as k", "id")
    groups = spark.createDataFrame([("k", 1), (None, 2)], "k string, g int")
    got = attach(rows, groups, ["k"], how=how, **HOT)
    want = rows.join(groups, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_busy_instant_in_a_wide_chunk_is_cut(spark):
    rows = spark.range(2000).selectExpr("'k' as k", "if(id < 1000, 50, id % 100) as pos", "id as tie", "1L as v")
    cut = with_chunks(rows, Order(("k",), "pos", "tie", width=1000), limit=100)
    assert cut.filter("pos = 50").select("_part").distinct().count() > 5
    w = Window.partitionBy("k").orderBy("pos", "tie")
    assert cut.withColumn("p", F.lag("_part").over(w)).filter(F.col("p") > F.col("_part")).count() == 0


def test_a_cut_is_made_once_by_a_binary_search(rows):
    """No list of marks is walked for every row, and what reads the chunks doesn't cut again."""
    from portledger.operators import scans

    order = Order(("k",), "pos", "tie", width=1000)
    bucketed = rows.withColumn("_bucket", F.lit(0).cast("long"))
    plan = scans._cut(bucketed, order, ["k", "_bucket"], 7)._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan
    chunked = with_chunks(rows, order, limit=100)
    assert chunked.select("_part").distinct().count() > 3
    assert "Join" not in chunked._jdf.queryExecution().toString()


def test_links_of_a_walk_never_pass_through_the_driver(spark, monkeypatch):
    from portledger.operators import chains

    plans, write = [], chains.staged
    monkeypatch.setattr(chains, "FEW", 0, raising=False)
    monkeypatch.setattr(chains, "staged", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or write(df, name))
    links = spark.range(50).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    assert chains.walk(links, links.filter("node = 0").select("node")).agg(F.max("hops")).first()[0] == 50
    assert chains.ends(links).select("end").distinct().collect()[0][0] == 50
    assert any("SortMergeJoin" in plan for plan in plans) and not any("BroadcastHashJoin" in plan for plan in plans)
