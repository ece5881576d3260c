"""Hash audits, input fingerprints, lineage walks and text scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portledger.operators.chains import walk
from portledger.sources.writers import require_clean

# What must not appear in published text.
FORBIDDEN_PATTERNS = {
    "absolute home-directory path": r"/(?:Users|home)/[a-z][a-z0-9._-]{2,}",
    "personal mailbox": (
        r"[A-Za-z0-9._%+-]+@(?:gmail|googlemail|outlook|hotmail|live|icloud|qq|163|126|foxmail)"
        r"\.[a-z]{2,3}\b"
    ),
    "OAuth access token": r"\bya29\.[A-Za-z0-9._-]{20,}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}

# CJK punctuation and its plain form.
PUNCTUATION = {
    "：": ": ",
    "，": ", ",
    "。": ". ",
    "；": "; ",
    "、": ", ",
    "（": " (",
    "）": ") ",
    "「": ' "',
    "」": '"',
    "％": "%",
    "｜": "|",
}
#: Fixed value: punctuation, ideographs, compatibility forms and full-width forms.
CJK_PATTERN = "[\\u3000-\\u303f\\u4e00-\\u9fff\\uf900-\\ufaff\\uff00-\\uffef]"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path, one task row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"),
        "length",
    )


def manifest_audit(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest entries against real hashes, full outer: MISSING, EXTRA, CHANGED."""
    want = manifest.select("name", F.col("sha256").alias("wanted"))
    have = found.select("name", F.col("sha256").alias("actual"))
    problem = (
        F.when(F.col("actual").isNull(), "MISSING")
        .when(F.col("wanted").isNull(), "EXTRA")
        .when(F.col("wanted") != F.col("actual"), "CHANGED")
    )
    return want.join(have, "name", "full_outer").withColumn("problem", problem).filter(
        F.col("problem").isNotNull()
    ).select("name", "problem")


def fingerprint(df: DataFrame, config: str, buckets: int = 4096) -> DataFrame:
    """One digest over a configuration and every row, whatever their order.

    Row digests are summed per bucket as exact numbers (order-free, partial
    aggregation, duplicates counted); the last digest is over ``buckets`` lines.
    """
    # Hash each value first: no separator can be confused with content, NULL stays apart.
    values = [
        F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in sorted(df.columns)
    ]
    row = F.sha2(F.concat(*values), 256)
    parts = [
        F.conv(F.substring("_h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)
    ]
    lines = (
        df.select(row.alias("_h"))
        .groupBy(F.pmod(F.conv(F.substring("_h", 61, 4), 16, 10).cast("long"), F.lit(buckets)).alias("_b"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
        .select(F.concat_ws("|", "_b", "n", *[f"s{i}" for i in range(5)]).alias("line"), "n")
    )
    return lines.agg(
        F.sha2(F.concat_ws("\n", F.lit(config), F.array_sort(F.collect_list("line"))), 256).alias("input_sha256"),
        F.sum("n").alias("input_rows"),
    )


def stamp(df: DataFrame, digest: DataFrame) -> DataFrame:
    return df.withColumn("input_sha256", digest.select("input_sha256").scalar())


def pattern_scan(docs: DataFrame, patterns: Mapping[str, str], *, key: str, body: str) -> DataFrame:
    """Hits of each pattern in each text; one narrow pass, patterns are literals."""
    found = F.array(
        *[
            F.struct(F.lit(label).alias("pattern"), F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0))).alias("hits"))
            for label, p in patterns.items()
        ]
    )
    return docs.select(key, F.explode(found).alias("_f")).select(key, "_f.*").filter(F.col("hits") > 0)


def phrase_rewrite(body: Column, phrases: Mapping[str, str]) -> Column:
    """Closed rewrite: longest phrase first, then punctuation, then spaces."""
    for source in sorted(phrases, key=len, reverse=True):
        body = F.replace(body, F.lit(source), F.lit(phrases[source]))
    for source, target in PUNCTUATION.items():
        body = F.replace(body, F.lit(source), F.lit(target))
    body = F.regexp_replace(body, r"(?<=\S)  +(?=\S)", " ")
    return F.regexp_replace(body, r" +(\n|$)", "$1")


def has_residue(body: Column, pattern: str = CJK_PATTERN) -> Column:
    return F.coalesce(body.rlike(pattern), F.lit(False))


def generation_chain(generations: DataFrame, heads: DataFrame) -> DataFrame:
    """Ancestors of each head along (parent id, parent hash) links, head included, however many there are.

    ``generations(transaction_id, parent_id, parent_hash, content_hash, batch_id)``.
    A link holds only when the parent's content has the hash the child recorded.
    Two manifests that claim to be one generation close the gate.
    """
    require_clean(ambiguous_parents(generations))
    children = generations.select(F.col("transaction_id").alias("node"), "parent_id", "parent_hash")
    parents = generations.select(F.col("transaction_id").alias("parent_id"), F.col("content_hash").alias("parent_hash"))
    links = children.join(parents, ["parent_id", "parent_hash"]).select("node", F.col("parent_id").alias("next"))
    reached = walk(links, heads.select(F.col("transaction_id").alias("node")))
    batches = generations.select(F.col("transaction_id").alias("node"), "batch_id")
    return reached.join(batches, "node").select("head", F.col("node").alias("transaction_id"), "batch_id", F.col("hops").cast("int").alias("hops"))


def find_batch(chain: DataFrame, generations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``found`` to wanted batches (head, batch_id, batch_hash): NEW, SAME, or CONFLICT for other content."""
    known = generations.select("transaction_id", F.col("batch_hash").alias("_known"))
    seen = chain.join(known, "transaction_id").groupBy("head", "batch_id").agg(
        F.min("_known").alias("_a"), F.max("_known").alias("_b")
    )
    rows = wanted.join(seen, ["head", "batch_id"], "left")
    same = (F.col("_a") == F.col("batch_hash")) & (F.col("_b") == F.col("batch_hash"))
    return rows.withColumn("found", F.when(F.col("_a").isNull(), "NEW").when(same, "SAME").otherwise("CONFLICT")).drop("_a", "_b")


def ambiguous_parents(generations: DataFrame) -> DataFrame:
    """Generations that two or more manifests claim to be."""
    return generations.groupBy("transaction_id", "content_hash").agg(
        F.count(F.lit(1)).alias("copies")
    ).filter(F.col("copies") > 1)
