"""A Merkle manifest of a table: leaves, subroots by source, one root, and every row's proof.

Leaves are numbered along (source, doc_id, leaf) by a range exchange and prefix sums of what each partition holds.
A superblock is SPAN consecutive leaves of a source, so a source of any size is cut into equal pieces. A first
pass reduces each superblock to one node and builds the levels above, which hold a SPAN-th of the rows; walking down
again gives each superblock the runs that its path to the root passes through. Leaves and these outer runs are
then cogrouped by superblock: its task reduces the leaves again, joins each leaf's proof and folds it to a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portledger.llm.common import doc_rows, with_fields
from portledger.sources.staging import staged

#: Nodes hashed into one, and leaves of a superblock: two levels of them.
FAN = 16
SPAN = FAN * FAN
#: One document in so many is tampered with.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows give the same bytes."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the group (its source, nulls first), the leaf and, where the row is tampered with, the leaf then."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return doc_rows(docs, *FIELDS).select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_group"),
        leaf(F.col("text")).alias("leaf"),
        F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("_tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``_at`` (from 0) along ``order`` within each _group, and ``_n``, the rows of the group.

    The exchange is by range of (_group, order), so that a large group is split over partitions.
    """
    sort = [F.col("_group"), *(F.col(c).asc_nulls_first() for c in order)]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    at = placed.columns.index("_group")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(at).to_numpy(zero_copy_only=False)
            first = np.ones(len(group), dtype=bool)
            first[0] = group[0] != last
            first[1:] = group[1:] != group[:-1]
            row = np.arange(len(group))
            start = np.maximum.accumulate(np.where(first, row, -n))
            place = row - start
            last, n = group[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(group), part, dtype=np.int32)), pa.array(place)],
                names=[*batch.schema.names, "_part", "_place"],
            )

    schema = with_fields(placed.schema, ("_part", T.IntegerType()), ("_place", T.LongType()))
    out = staged(placed.mapInArrow(task, schema), "manifest-order")
    held = out.groupBy("_group", "_part").agg(F.count("*").alias("_held"))
    # One row for each partition of a group: sums of what the partitions before hold.
    runs = held.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_part", "_held"))).alias("_parts"), F.sum("_held").alias("_n"))
    running = F.aggregate(
        "_parts",
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<_part:int,_before:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["sum"] + x["_held"]).alias("sum"),
            F.concat(acc["out"], F.array(F.struct(x["_part"].alias("_part"), acc["sum"].alias("_before")))).alias("out"),
        ),
    )
    starts = runs.select("_group", "_n", F.inline(running["out"]))
    return out.join(starts, ["_group", "_part"]).withColumn("_at", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def level(nodes: DataFrame) -> DataFrame:
    """The nodes SPAN-fold above (_group, _at, hash, _n) with the run below each and, of large groups, what is between.

    A run of FAN nodes becomes one, twice; a group's only node is its root and stays.
    """
    runs = nodes.groupBy("_group", F.floor(F.col("_at") / SPAN).cast("long").alias("_above")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "hash"))), lambda x: x["hash"]).alias("run"), F.max("_n").alias("_below")
    )
    first = F.sequence(F.lit(1), F.size("run"), F.lit(FAN))
    runs = runs.withColumn("between", F.transform(first, lambda i: F.sha2(F.array_join(F.slice("run", i, FAN), ""), 256)))
    return runs.select(
        "_group",
        F.col("_above").alias("_at"),
        F.when(F.col("_below") == 1, F.col("run")[0])
        .when(F.col("_below") <= FAN, F.col("between")[0])
        .otherwise(F.sha2(F.array_join("between", ""), 256))
        .alias("hash"),
        F.ceil(F.col("_below") / SPAN).cast("long").alias("_n"),
        "run",
        "between",
        "_below",
    )


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Each level above ``nodes``, up to one node in every group; how many is known from the largest group."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        out.append(staged(level(out[-1].select("_group", "_at", "hash", "_n")), name))
        most = -(-most // SPAN)
    return out


def downward(tree: list[DataFrame], roots: DataFrame) -> DataFrame:
    """_group, _at and path of the lowest nodes: from ``roots`` (_group, path) down, each node's runs, lowest first."""
    paths = roots.withColumn("_at", F.lit(0).cast("long"))
    for upper in reversed(tree[1:]):
        nodes = upper.select("_group", "_at", "run", "between", "_below").join(paths, ["_group", "_at"])
        each = nodes.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.size("run") - 1)))
        place, run = F.col("_slot") % FAN, F.floor(F.col("_slot") / FAN).cast("int")
        near = F.array(F.struct(place.alias("slot"), F.slice("run", run * FAN + 1, FAN).alias("run")))
        far = F.array(F.struct(run.alias("slot"), F.col("between").alias("run")))
        paths = each.select(
            "_group",
            (F.col("_at") * SPAN + F.col("_slot")).alias("_at"),
            *(c for c in roots.columns if c not in ("_group", "path")),
            F.when(F.col("_below") == 1, F.col("path"))
            .when(F.col("_below") <= FAN, F.concat(near, "path"))
            .otherwise(F.concat(near, far, "path"))
            .alias("path"),
        )
    return paths


PATH = "array<struct<slot:int,run:array<string>>>"


def outer_runs(rows: DataFrame) -> DataFrame:
    """_group, _block, subroot, root and path of every superblock of the numbered leaves ``rows``."""
    nodes = rows.select("_group", "_at", F.col("leaf").alias("hash"), "_n")
    tree = levels(staged(level(nodes).select("_group", "_at", "hash", "_n"), "manifest-blocks"), "manifest-level")
    subroots = tree[-1].select("_group", F.col("hash").alias("subroot"))
    named = numbered(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_source"), "subroot"), ["_source"])
    top = levels(named.select("_group", "_at", F.col("subroot").alias("hash"), "_n"), "manifest-top")
    root = top[-1].select("_group", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    above = downward(top, root).join(named.select("_at", "_source", "subroot"), "_at")
    return downward(tree, above.select(F.col("_source").alias("_group"), "subroot", "root", "path")).withColumnRenamed("_at", "_block")


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def sides(run: list[bytes], slot: int) -> tuple[bytes, bytes]:
    return b"".join(run[:slot]), b"".join(run[slot + 1 :])


def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """One superblock: local reduction, proof joining and folding of all its leaves."""
    if not len(rows):
        return pd.DataFrame({name: [] for name in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")})
    rows = rows.sort_values("_at")
    total, head = int(rows["_n"].iloc[0]), outer.iloc[0]
    root = head["root"].encode()
    beyond = [sides([h.encode() for h in step["run"]], int(step["slot"])) for step in head["path"]]
    local, nodes, count = [], [h.encode() for h in rows["leaf"]], total
    span = SPAN
    while span > 1 and count > 1:
        runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        local.append(runs)
        nodes = [digest(b"".join(run)) for run in runs]
        count, span = -(-count // FAN), span // FAN
    proofs, folded = [], []
    outside = b"".join(left + right for left, right in beyond)
    for i, (own, changed) in enumerate(zip(rows["leaf"], rows["_tampered"])):
        steps, at = [], i
        for runs in local:
            steps.append(sides(runs[at // FAN], at % FAN))
            at //= FAN
        proofs.append(digest(b"".join(left + right for left, right in steps) + outside).decode())
        node = (own if changed is None else changed).encode()
        for left, right in steps + beyond:
            node = digest(left + node + right)
        folded.append(node.decode())
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].to_numpy(),
            "leaf": rows["leaf"].to_numpy(),
            "subroot": head["subroot"],
            "root": head["root"],
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root.decode() for f in folded],
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Nulls are told from empty values in each column; a null source is a source of its own, the first. Rows
    without an id come first in theirs and are never tampered with. Rows of one id are ordered by their leaves, so
    repeated rows have the same leaf and different proofs. Texts of any length are hashed where they are read
    and travel no further. Other columns are ignored. An empty table gives no rows.
    """
    rows = staged(leaves(docs), "manifest-leaves")
    rows = staged(numbered(rows, ["doc_id", "leaf"]), "manifest-numbered")
    outer = staged(outer_runs(rows), "manifest-outer")
    rows = rows.withColumn("_block", F.floor(F.col("_at") / SPAN).cast("long"))
    doc_id = next(f for f in rows.schema if f.name == "doc_id")
    schema = (
        f"doc_id {doc_id.dataType.simpleString()}, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean"
    )
    keys = ["_group", "_block"]
    # Nullable ids would become floats in pandas: they travel as text.
    sent = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = sent.groupBy(*keys).cogroup(outer.groupBy(*keys)).applyInPandas(finish, schema.replace(doc_id.dataType.simpleString(), "string", 1))
    return done.withColumn("doc_id", F.col("doc_id").cast(doc_id.dataType))


def sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """The same in SQL, for tables of up to FAN ** source_levels rows in a source and FAN ** top_levels sources."""

    def enc(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"

    parts = [
        # CRC-32 by its reflected polynomial, one bit a step.
        "bits AS (SELECT doc_id, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, 1 + length(doc_id::VARCHAR)), "
        "lambda i: [ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
        "lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384::BIGINT)) AS crc "
        "FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))",
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {hashed('text')} AS leaf, "
        f"CASE WHEN xor(crc, 4294967295::BIGINT) % {TAMPERED} = 0 THEN {hashed(f'translate(text, {chr(39)}{UPPER}{chr(39)}, {chr(39)}{LOWER}{chr(39)})')} END AS tampered "
        "FROM documents LEFT JOIN (SELECT doc_id AS bits_id, crc FROM bits) ON doc_id = bits_id)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "s0 AS (SELECT g, pos, leaf AS hash, n FROM l)",
    ]

    def up(name: str, count: int) -> None:
        for i in range(count):
            parts.append(f"{name}r{i} AS (SELECT g, pos // {FAN} AS pos, list(hash ORDER BY pos) AS run, max(n) AS n FROM {name}{i} GROUP BY ALL)")
            parts.append(
                f"{name}{i + 1} AS (SELECT g, pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash, "
                f"(n + {FAN - 1}) // {FAN} AS n FROM {name}r{i})"
            )

    up("s", source_levels)
    parts.append(f"subroots AS (SELECT g, hash AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM s{source_levels})")
    parts.append("t0 AS (SELECT '' AS g, place AS pos, subroot AS hash, count(*) OVER () AS n FROM subroots)")
    up("t", top_levels)
    steps = [(f"s{i}", f"sr{i}", "l.g", f"l.pos // {FAN**i}") for i in range(source_levels)]
    steps += [(f"t{i}", f"tr{i}", "''", f"place // {FAN**i}") for i in range(top_levels)]
    joins, sides_ = [], []
    for i, (_, runs, group, at) in enumerate(steps):
        joins.append(f"JOIN {runs} r{i} ON r{i}.g = {group} AND r{i}.pos = ({at}) // {FAN}")
        slot = f"(({at}) % {FAN})::INTEGER"
        left, right = f"array_to_string(r{i}.run[1:{slot}], '')", f"array_to_string(r{i}.run[{slot} + 2:], '')"
        sides_.append(f"CASE WHEN r{i}.n = 1 THEN NULL ELSE {left} END AS a{i}, CASE WHEN r{i}.n = 1 THEN NULL ELSE {right} END AS b{i}")
    parts.append(
        f"p AS (SELECT l.doc_id, l.leaf, subroots.subroot, t{top_levels}.hash AS root, coalesce(l.tampered, l.leaf) AS f0, {', '.join(sides_)} "
        f"FROM l JOIN subroots ON subroots.g = l.g JOIN t{top_levels} ON true {' '.join(joins)})"
    )
    for i in range(len(steps)):
        parts.append(
            f"f{i + 1} AS (SELECT * EXCLUDE (f{i}), CASE WHEN a{i} IS NULL THEN f{i} ELSE sha256(a{i} || f{i} || b{i}) END AS f{i + 1} FROM {'p' if not i else f'f{i}'})"
        )
    proof = " || ".join(f"coalesce(a{i} || b{i}, '')" for i in range(len(steps)))
    n = len(steps)
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{n} AS folded_root, f{n} = root AS verified FROM f{n}"
    )
