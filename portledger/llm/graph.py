"""Connected components of a link table by alternating stars.

Each half round ties every node to the smallest one it sees, first its larger neighbours, then its smaller
ones, until every component is a star around its smallest node. Rounds are written to the shared
folder; only a count and a checksum of each come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.sources.staging import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (a, b); others are on their own."""
    pairs = links.filter("a != b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    now, seen = staged(pairs.distinct(), "links"), None
    while True:
        now = staged(_large_star(now).filter("u != v").distinct(), "large-star")
        now = staged(_small_star(now).filter("u != v").distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
