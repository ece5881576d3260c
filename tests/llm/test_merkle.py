import hashlib
import zlib
from collections import defaultdict

import pytest

from portledger.llm import merkle


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root and, for each leaf, its sides level by level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j in range(len(at)):
            run = nodes[at[j] // 16 * 16 : at[j] // 16 * 16 + 16]
            sides[j].append(("".join(run[: at[j] % 16]), "".join(run[at[j] % 16 + 1 :])))
            at[j] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], sides


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]])
    root, above = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        subroot, sides = trees[s]
        for (_, _, own, row), path in zip(groups[s], sides):
            path, doc_id, text = path + above[k], row["doc_id"], row["text"]
            node = own
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                node = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for left, right in path:
                node = h(left, node, right)
            out.append((doc_id, own, subroot, root, h(*(a + b for a, b in path)), node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def check(spark, rows, schema):
    got = merkle.manifest(spark.createDataFrame(rows, schema).repartition(4)).collect()
    names = [part.split()[0] for part in schema.split(", ")]
    want = brute([dict(zip(names, row)) for row in rows])
    assert order(got) == order(want)
    return got


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _group string, leaf int"


def test_every_height(spark):
    """Sources of one row, one run, one superblock, several, and more sources than a run holds."""
    sizes = {"one": 1, "run": 16, "run1": 17, "block": 256, "block1": 257, "hot": 4400, None: 5, "": 3, "é": 2, "Z": 2}
    sizes |= {f"s{i}": 1 for i in range(300)}
    rows = [(1000 * k + i, f"Text {i} of {s}", "en", s, i, "x", 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = check(spark, rows, SCHEMA)
    assert len({r["root"] for r in got}) == 1
    tampered = {r["doc_id"] for r in got if not r["verified"]}
    assert tampered == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids."""
    rows = [
        (None, None, None, None, None, "x", 1),
        (None, "", "", "", 0, "x", 1),
        (5, None, "en", "a", None, "x", 1),
        (5, "", "en", "a", 0, "x", 1),
        (5, "", "en", "a", 0, "x", 1),
        (7, "ÀB " * 200_000, "de", "a", 3, "x", 1),
        (7, "-", "-", "-", -4, "x", 1),
        (-9, "Ünï 日本", None, "a", 2, "x", 1),
    ] + [(11, "Same Row", "en", "b", 8, "x", 1)] * 40
    check(spark, rows, SCHEMA)


def test_nothing_and_clashing_names(spark, no_docs):
    assert merkle.manifest(no_docs).collect() == []
    assert merkle.manifest(no_docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    check(spark, [(i, "A", "en", "s", 1, "x", 1) for i in range(n)], SCHEMA)
