"""Nearest neighbours by robust-pruned directed graphs, one a shard, searched by beams.

Vectors are dealt to shards of a bounded size by their norm, so that in a shard the largest inner product is nearly the
smallest angle, and by their hash, so that equal vectors meet. In each shard a graph is grown in rounds: a beam search from the middle of the shard proposes neighbours for each new vector, and
pruning keeps the nearest one, drops what is nearer to it by the factor ALPHA than to the vector, and goes on with
the rest, so that edges point in different directions. Edges back are added and pruned alike. Vectors that no
edge leads to become starts of their own. Every query runs a beam through every shard, in blocks of queries; the
best of all shards are its answer, with scores from the vectors as given.

The largest inner product is the smallest distance once every vector has one more coordinate that makes all norms
equal; graphs are grown on these.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portledger.sources.staging import staged

#: Neighbours of a query, and one query in so many rows.
TOP, EVERY = 20, 20
#: Vectors of a shard and queries of a block; these bound the memory of a task.
SHARD, QUERIES = 8192, 2048
#: Edges of a vector, width of the beams that grow a graph and that search it, and what pruning relaxes by.
DEGREE, GROWING, BEAM, ALPHA = 32, 64, 64, 1.2
#: Norms of a shard differ by at most this factor.
NORMS = 1.25
#: Vectors added in a round at most, searches run side by side, nodes a beam opens in a step.
ROUND, SIDE, OPENED = 512, 512, 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one a vec_id."""
    value = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(fine).select("vec_id", value.alias("vector"))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def beams(points: np.ndarray, links: np.ndarray, starts: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a beam finds for each of ``wanted``, nearest first (-1: none), and their distances.

    All beams take their steps together; each opens its nearest unopened nodes until none is left.
    """
    n, rows = len(wanted), np.arange(len(wanted))[:, None]
    norm = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", wanted, wanted)

    def distances(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared; nodes of -1 are infinitely far."""
        at = np.maximum(nodes, 0)
        out = norm[at] + own[who][:, None] - 2 * np.einsum("arj,aj->ar", points[at], wanted[who])
        return np.where(nodes < 0, np.inf, out)

    met = np.zeros((n, len(points)), bool)
    met[:, starts] = True
    first = np.broadcast_to(starts, (n, len(starts)))
    found = np.full((n, max(width, len(starts))), -1, np.int32)
    far = np.full(found.shape, np.inf)
    found[:, : len(starts)] = first
    far[:, : len(starts)] = distances(np.arange(n), first)
    order = np.argsort(far, axis=1, kind="stable")[:, :width]
    found, far = found[rows, order], far[rows, order]
    opened = found < 0
    active = np.arange(n)
    while len(active):
        waiting = np.where(opened[active], np.inf, far[active])
        nearest = np.argpartition(waiting, OPENED - 1, axis=1)[:, :OPENED] if width > OPENED else np.argsort(waiting, axis=1)
        going = np.isfinite(np.take_along_axis(waiting, nearest, 1))
        some = going.any(axis=1)
        active, nearest, going = active[some], nearest[some], going[some]
        if not len(active):
            break
        line, new = np.arange(len(active))[:, None], []
        for i in range(nearest.shape[1]):
            at = nearest[:, i]
            opened[active[going[:, i]], at[going[:, i]]] = True
            nodes = np.where(going[:, i, None], links[np.maximum(found[active, at], 0)], -1)
            nodes = np.where((nodes >= 0) & ~met[active[:, None], np.maximum(nodes, 0)], nodes, -1)
            hit = np.nonzero(nodes >= 0)
            met[active[hit[0]], nodes[hit]] = True
            new.append(nodes)
        new = np.concatenate(new, axis=1)
        all_nodes = np.concatenate([found[active], new], axis=1)
        all_far = np.concatenate([far[active], distances(active, new)], axis=1)
        all_open = np.concatenate([opened[active], new < 0], axis=1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        found[active], far[active], opened[active] = all_nodes[line, keep], all_far[line, keep], all_open[line, keep]
    order = np.argsort(far, axis=1, kind="stable")
    return found[rows, order], far[rows, order]


def prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours of each of ``owners`` among its row of ``candidates`` (-1: none)."""
    out = np.full((len(owners), DEGREE), -1, np.int32)
    for start in range(0, len(owners), 128):
        who, nodes = owners[start : start + 128], candidates[start : start + 128]
        nodes = np.where(nodes == who[:, None], -1, nodes)
        there = points[np.maximum(nodes, 0)]
        far = np.linalg.norm(there - points[who][:, None], axis=2)
        far[nodes < 0] = np.inf
        square = np.einsum("acj,acj->ac", there, there)
        between = square[:, :, None] + square[:, None, :] - 2 * there @ there.transpose(0, 2, 1)
        between = ALPHA * np.sqrt(np.maximum(between, 0))
        left, row = far.copy(), np.arange(len(who))
        for i in range(DEGREE):
            best = left.argmin(axis=1)
            alive = np.isfinite(left[row, best])
            if not alive.any():
                break
            out[start + row[alive], i] = nodes[row[alive], best[alive]]
            left[between[row, best] <= far] = np.inf
            left[row, best] = np.inf
    return out


def padded(owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as one row of nodes an owner, filled with -1."""
    order = np.argsort(owner, kind="stable")
    owner, node = owner[order], node[order]
    owners, start, count = np.unique(owner, return_index=True, return_counts=True)
    out = np.full((len(owners), count.max(initial=1)), -1, np.int32)
    place = np.arange(len(owner)) - np.repeat(start, count)
    out[np.repeat(np.arange(len(owners)), count), place] = node
    return owners, out


def reached(links: np.ndarray, start: int, seen: np.ndarray) -> None:
    edge = np.array([start])
    seen[start] = True
    while len(edge):
        edge = np.unique(links[edge])
        edge = edge[edge >= 0]
        edge = edge[~seen[edge]]
        seen[edge] = True


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) of each point, all different, and the starts from which every point can be reached."""
    n = len(points)
    links = np.full((n, DEGREE), -1, np.int32)
    middle = int(np.linalg.norm(points - points.mean(axis=0), axis=1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[middle, order[order != middle]].astype(np.int32)
    done = 1
    while done < n:
        # Rounds double, so that early vectors find each other.
        new = order[done : done + min(ROUND, done)]
        near = [beams(points, links, np.array([middle], np.int32), points[new[i : i + SIDE]], GROWING)[0] for i in range(0, len(new), SIDE)]
        # Vectors of one round propose themselves to each other.
        close = points[new] @ points[new].T
        close = (close.diagonal()[None, :] - 2 * close).argsort(axis=1)[:, : DEGREE // 2 + 1]
        links[new] = prune(points, new, np.concatenate([np.concatenate(near), new[close]], axis=1))
        owner, slot = np.nonzero(links[new] >= 0)
        targets, sources = padded(links[new][owner, slot], new[owner])
        both = np.concatenate([links[targets], sources], axis=1)
        both[:, DEGREE:][(sources[:, :, None] == links[targets][:, None, :]).any(axis=2)] = -1
        many = (both >= 0).sum(axis=1) > DEGREE
        few = np.sort(both[~many], axis=1)[:, ::-1][:, :DEGREE]
        links[targets[~many]] = few
        # Rows with few candidates need little room.
        wide = targets[many]
        links[wide] = prune(points, wide, both[many])
        done += len(new)
    seen, starts = np.zeros(n, bool), [middle]
    reached(links, middle, seen)
    while not seen.all():
        starts.append(int(np.flatnonzero(~seen)[0]))
        reached(links, starts[-1], seen)
    return links, np.array(starts, np.int32)


def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard: its rows with their edges; starts are marked."""
    rows = rows.sort_values("first_id", ignore_index=True)
    vectors = np.stack(rows["vector"].to_numpy())
    more = np.sqrt(np.maximum(rows["_square"].to_numpy() - np.einsum("ij,ij->i", vectors, vectors), 0))
    links, starts = grow(np.column_stack([vectors, more]))
    rows["node"] = np.arange(len(rows))
    rows["links"] = [row[row >= 0] for row in links]
    rows["start"] = False
    rows.loc[starts, "start"] = True
    return rows[["size", "band", "shard", "node", "first_id", "ids", "vector", "links", "start"]]


def search(top: int, beam: int):
    def run(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The best of one shard for a block of queries, with whole scores."""
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(graph) or not len(queries):
            return none
        graph, queries = graph.sort_values("node"), queries.sort_values("query_id")
        vectors, wanted = np.stack(graph["vector"].to_numpy()), np.stack(queries["vector"].to_numpy())
        links = np.full((len(graph), max(DEGREE, *map(len, graph["links"]))), -1, np.int32)
        for i, row in enumerate(graph["links"]):
            links[i, : len(row)] = row
        square = np.einsum("ij,ij->i", vectors, vectors)
        points = np.column_stack([vectors, np.sqrt(np.maximum(square.max() - square, 0))])
        starts = np.flatnonzero(graph["start"].to_numpy()).astype(np.int32)
        owners, ids, out = queries["query_id"].to_numpy(), graph["ids"].to_numpy(), []
        # A node is one vector; its rows are its smallest ids.
        sizes = np.array([len(x) for x in ids])
        flat, begin = np.concatenate(ids), np.r_[0, np.cumsum(sizes)[:-1]]
        for i in range(0, len(wanted), SIDE):
            q = wanted[i : i + SIDE]
            found, _ = beams(points, links, starts, np.column_stack([q, np.zeros(len(q))]), beam)
            who, slot = np.nonzero(found >= 0)
            node = found[who, slot]
            score = (vectors[node] * q[who]).sum(axis=1)
            line = np.repeat(np.arange(len(node)), sizes[node])
            place = np.arange(len(line)) - np.repeat(np.cumsum(sizes[node]) - sizes[node], sizes[node])
            part = pd.DataFrame({"query_id": owners[i + who[line]], "vec_id": flat[begin[node[line]] + place], "score": score[line]})
            part = part[part["query_id"] != part["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(part.groupby("query_id").head(top))
        return pd.concat(out) if out else none

    return run


def neighbours(
    vectors: DataFrame, *, top: int = TOP, every: int = EVERY, shard: int = SHARD, block: int = QUERIES, beam: int = BEAM
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest rows found of each row whose vec_id ``every`` divides.

    Rows without an id, without a vector, with a zero vector or with components that are null or not finite take no
    part. Vectors of different lengths aren't compared. Of rows with one id the smallest vector counts. Ties go to
    the smaller vec_id; of equal vectors only so many of the smallest ids can be among the nearest, and the others
    aren't searched. Other columns are ignored. An empty table gives no rows.
    """
    rows = staged(usable(vectors).withColumn("size", F.size("vector")), "vectors")
    # Of equal vectors the first top + 1 ids: one may be the query itself.
    alike = Window.partitionBy("vector").orderBy("vec_id")
    alike = rows.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= top + 1)
    distinct = alike.groupBy("size", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x / F.col("_largest") / F.col("_largest"))
    distinct = distinct.withColumn("_largest", largest).withColumn("_norm", F.log("_largest") + F.log(scaled) / 2)
    distinct = distinct.withColumn("band", F.rint(F.col("_norm") / math.log(NORMS)).cast("int")).withColumn("first_id", F.col("ids")[0])
    distinct = staged(distinct.drop("_largest"), "distinct-vectors")
    # One row for each length of vectors and band of norms.
    sizes = distinct.groupBy("size", "band").agg(F.ceil(F.count("*") / shard).cast("int").alias("_shards"), F.exp(2 * F.max("_norm")).alias("_square"))
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", "size")
    blocks = asked.groupBy("size").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    sizes = staged(sizes.join(blocks, "size"), "vector-sizes")
    dealt = distinct.drop("_norm").join(sizes, ["size", "band"]).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("_shards")).cast("int"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"size int, band int, shard int, node int, first_id {kind}, ids array<{kind}>, vector array<double>, links array<int>, start boolean"
    keys = ["size", "band", "shard"]
    graphs = staged(dealt.groupBy(*keys).applyInPandas(build, schema), "vector-graphs").drop("first_id")
    blocked = graphs.join(blocks, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    asked = asked.join(sizes, "size").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).select(*keys, "block", "query_id", "vector")
    keys.append("block")
    found = (
        blocked.drop("_blocks")
        .groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(search(top, beam), f"query_id {kind}, vec_id {kind}, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")

