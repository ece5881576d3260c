import re
from collections import Counter, defaultdict

import pytest

from portledger.llm import divergence as d


def brute(rows):
    """The contract's words in plain Python, with unbounded integers."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = [t.translate(upper) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        sources = sorted(g[1] for g in groups if g[0] == lang)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(own[s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            listed = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]}
            listed["term"] = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in listed.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < 10]
    return sorted(out)


def words(i):
    return " ".join(f"W{(i * j + j) % 37:02d}".replace("0", "o").replace("1", "é").replace("2", "Ü") for j in range(1, 12 + i % 5))


@pytest.fixture(scope="module")
def rows():
    out = [(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], words(i)) + " é_É7日本a", ("en", "de")[i % 2], f"s{i % 7}") for i in range(150)]
    # A hot source, groups without terms, nulls, a language that keeps nothing, ties and a long text.
    out += [("Apple APPLE pear " * 3, "en", "hot")] * 120
    out += [(None, "en", "none"), ("", "en", "empty"), ("12 ! _", "fr", "x"), ("rare", "fr", "y"), (None, None, None), ("a b", None, None), ("k " * 5, "", None)]
    out += [("tie knot bow " + "loop", "en", "s1")] * 12 + [("long LONG word " * 60_000, "de", "s0")]
    return out


COLUMNS = "text string, lang string, source string, term int, digest string, split string, count string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], COLUMNS).repartition(5)


@pytest.mark.parametrize("bits, block, tile", [(64, 4096, 32), (4, 8, 3), (0, 4096, 2)])
def test_equals_brute_force(spark, rows, bits, block, tile):
    """Also where a digest stands for many terms, or for all, and where terms and sources are cut small."""
    got = d.divergence(frame(spark, rows), bits=bits, block=block, tile=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_tasks_give_counts_out_when_many(spark, rows, monkeypatch):
    counts = d.Counts(64, False)
    monkeypatch.setattr(d, "TERMS", 20)
    monkeypatch.setattr(d, "HELD", 30)
    total, named = Counter(), defaultdict(set)
    for text, lang, source in rows:
        counts.add((lang, source), (text or "").encode())
        if counts.full():
            for batch in counts.rows():
                for r in batch.to_pylist():
                    total[r["lang"], r["source"], r["digest"]] += r["count"]
                    named[r["digest"]].add(r["term"])
    for batch in counts.rows():
        for r in batch.to_pylist():
            total[r["lang"], r["source"], r["digest"]] += r["count"]
            named[r["digest"]].add(r["term"])
    upper = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    assert sum(total.values()) == sum(len(upper.findall(text or "")) for text, _, _ in rows)
    assert all(len(terms - {None}) == 1 for terms in named.values())


def test_shares_are_exact():
    import numpy as np

    for count, total, terms in [(0, 1, 1), (7, 10**14, 12345), (10**14, 10**14, 1), (3, 7, 2)]:
        got = d.share(np.array([count]), np.array([total]), terms)[0]
        assert got == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_empty_table(spark, no_docs):
    assert d.divergence(no_docs).collect() == []
