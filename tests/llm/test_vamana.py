import math

import numpy as np
import pytest

from portledger.llm import vamana

COLUMNS = "vec_id long, embedding array<float>, label int, vector string, size string, shard int, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", "y", 2, 3) for i, v in rows], COLUMNS).repartition(4)


def exact(rows, top=20, every=20):
    """query_id -> [(score, vec_id)] by comparing each query with every row."""
    fine = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(np.array(v, np.float32).astype(float))
        fine[i] = min(fine.get(i, v), v)
    out = {}
    for i, v in fine.items():
        if i % every == 0:
            scores = [(-math.fsum(a * b for a, b in zip(v, w)), j) for j, w in fine.items() if j != i and len(w) == len(v)]
            out[i] = [(-s, j) for s, j in sorted(scores)[:top]]
    return {i: found for i, found in out.items() if found}


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({j for _, j in got.get(i, [])} & {j for _, j in w}) for i, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("shard, block", [(8192, 2048), (500, 7)])
def test_recall(spark, shard, block):
    """Random directions, norms from 0.2 to 3, and a dense group that holds a third of the rows."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 32)) * rng.uniform(0.2, 3, (3000, 1)) / 5
    v[::3] = rng.normal(size=32) / 5 + rng.normal(size=(1000, 32)) * 0.01
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = answers(vamana.neighbours(frame(spark, rows), shard=shard, block=block)), exact(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.97
    for i, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[0], x[1]))
        true = dict((j, s) for s, j in exact([rows[i], *(rows[j] for _, j in found)], every=1)[i])
        assert all(abs(true[j] - s) < 1e-12 for s, j in found)


def test_edges_are_exact(spark):
    """Few rows: ties, equal vectors beyond the answer's length, rows that take no part, lengths of their own."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(60)] + [(100 + i, [i % 3, 1.0, -i % 5]) for i in range(30)]
    rows += [(40, [1.0, 2.0, 0.5]), (200, None), (201, []), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [1.0, float("nan"), 2.0])]
    rows += [(280, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (300, [1.0, 1.0]), (301, [2.0, 1.0]), (320, [3.0, 1.0, 4.0, 1.0])]
    rows += [(-20, [9.0, 9.0, 9.0]), (340, [1.0, 0.0, 0.0]), (340, [0.0, 1.0, 0.0])]
    assert answers(vamana.neighbours(frame(spark, rows), shard=30, block=3)) == exact(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert vamana.neighbours(none).collect() == []


def test_every_vector_can_be_reached():
    points = np.random.default_rng(1).normal(size=(700, 8))
    points[200:260] = points[200] + 1e-9 * np.arange(60)[:, None]
    links, starts = vamana.grow(points)
    seen = np.zeros(len(points), bool)
    for start in starts:
        vamana.reached(links, start, seen)
    assert seen.all()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(links))
