"""Walks along links (one successor a node) by pointer doubling.

Each round joins the links with themselves, so a chain of n links takes log2(n) rounds; rounds are
written to the shared folder and only a count of each comes to the driver. Links are joined by sorting both
sides: a small file may hold many of them, and a planner that goes by its size would send them all through the driver.

Doubling passes all links in each round, also those that no head reaches. Many links are shortened first: a round
takes out about a quarter of the nodes, no two of them neighbours, so all rounds together pass four times the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from portledger.sources.staging import staged

#: Reached nodes that may be sent to every task.
FEW = 10_000
#: Links that are doubled as they are.
SMALL = 1 << 18


def walk(links: DataFrame, heads: DataFrame) -> DataFrame:
    """head, node and hops of every node that a head reaches along ``links`` (node, next), itself included.

    A node has at most one ``next``. A walk that comes back to where it was stops after as many
    hops as there are links.
    """
    jumps = staged(links.select("node", "next").filter("next is not null"), "jumps")
    reached = staged(heads.select(F.col("node").alias("head"), "node", F.lit(0).cast("long").alias("hops")), "reached")
    most, size = jumps.count(), reached.count()
    # The first power of two above the number of links, which only a cycle comes to.
    end = 1 << most.bit_length()
    step, rounds = 1, []
    jumps = jumps.withColumn("far", F.lit(1).cast("long"))
    if most > SMALL:
        jumps, rounds = _shortened(jumps, heads.select("node"), most)

    def reach(jumps: DataFrame) -> int:
        nonlocal reached, size
        known = F.broadcast(reached) if size <= FEW else reached.hint("merge")
        further = known.join(jumps, "node").select("head", F.col("next").alias("node"), (F.col("hops") + F.col("far")).alias("hops"))
        further = staged(further.filter(F.col("hops") < end), "reached-further")
        more = further.count()
        reached, size = reached.unionByName(further), size + more
        return more

    while step <= most and reach(jumps):
        second = jumps.select(F.col("node").alias("next"), F.col("next").alias("_after"), F.col("far").alias("_more"))
        twice = jumps.hint("merge").join(second, "next").select("node", F.col("_after").alias("next"), (F.col("far") + F.col("_more")).alias("far"))
        jumps = staged(twice.filter(F.col("far") < end), "jumps")
        step *= 2
    for passed in reversed(rounds):
        reach(passed)
    return reached


def _shortened(jumps: DataFrame, heads: DataFrame, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """Fewer links (node, next, far) between the heads and other nodes, and the nodes each round took out.

    A round takes out a node whose coin shows heads and whose successor's shows tails; so the successor stays, and what led to the
    node leads to its successor instead. Heads and nodes of several links stay. A round's own table says
    which staying node led to which one taken out (node, next, far): a walk passes the latter after the former.
    """
    forks = jumps.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("node")
    pins = staged(heads.union(forks).filter("node is not null").distinct(), "pins")
    few = pins.count() <= FEW
    pins = pins.withColumn("_pinned", F.lit(True))
    links = jumps.hint("merge").join(F.broadcast(pins) if few else pins, "node", "left").withColumn("_pinned", F.col("_pinned").isNotNull())
    if not few:
        links = staged(links, "pinned-jumps")
    rounds = []
    while size > SMALL:
        node, after = [F.xxhash64(F.lit(len(rounds)), c) % 2 == 0 for c in ("node", "next")]
        out = ~F.col("_pinned") & node & ~after
        gone = links.filter(out).select(F.col("node").alias("next"), F.col("next").alias("_after"), F.col("far").alias("_more"))
        moved = links.filter(~out & after).hint("merge").join(gone, "next", "left").select(
            "node", F.coalesce("_after", "next").alias("next"), (F.col("far") + F.coalesce("_more", F.lit(0))).alias("far"), "_pinned",
            F.when(F.col("_after").isNotNull(), F.struct("next", "far")).alias("_passed"),
        )
        links = staged(moved.unionByName(links.filter(~out & ~after).drop("_passed"), allowMissingColumns=True), "short-jumps")
        rounds.append(links.filter("_passed is not null").select("node", "_passed.*"))
        before, size = size, links.count()
        if size > 0.9 * before:
            break
    return links.select("node", "next", "far"), rounds


def ends(links: DataFrame) -> DataFrame:
    """node and end, the last node its walk along ``links`` (node, next) comes to; cycles keep some node of theirs."""
    now = staged(links.select("node", F.col("next").alias("end")).filter("end is not null"), "ends")
    step, most = 1, now.count()
    while step <= most:
        further = now.select(F.col("node").alias("end"), F.col("end").alias("_after"))
        now = staged(now.hint("merge").join(further, "end", "left").select("node", F.coalesce("_after", "end").alias("end"), F.col("_after").isNotNull().alias("_moved")), "ends")
        if now.filter("_moved").isEmpty():
            break
        now, step = now.drop("_moved"), step * 2
    return now.select("node", "end")
