"""How much the sources of a language differ in their terms, with texts of terms joined back at the end.

Tasks count the terms of each (lang, source) and give them fixed-width digests; every count, document frequency and
comparison is shuffled by digest. A term's text is written once for each task that meets it, in a column that
those steps don't read. The smallest and the largest text of a digest tell whether it stands for several terms:
such digests are counted again with their texts and split by numbers, in the order of the texts. Only what the
result names is joined with its text.

Pairs of sources are compared in tiles: a task holds a block of terms for two small sets of sources and adds up
what it has for each pair of them. Terms that neither source of a pair has all give the same value, so
they are counted and not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, doc_rows, slices
from portledger.sources.staging import staged

#: Documents of a language that a term needs, terms listed for a group, parts that make one whole.
LEAST, TOP, WHOLE = 10, 10, 1_000_000_000
#: Terms of a block and sources of a tile, which bound the memory of a comparing task.
BLOCK, TILE = 4096, 32
#: Terms a task remembers and counts it gathers before it gives them out.
TERMS, HELD = 200_000, 1_000_000
BITS = 64

#: All bytes but ASCII letters and those of other characters part terms; A-Z becomes a-z.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Counts:
    """Counts of the terms of groups, given out as rows when there are many."""

    def __init__(self, bits: int, every: bool):
        self.mask, self.every = (1 << bits) - 1, every
        self.clear()

    def clear(self) -> None:
        self.terms, self.digests, self.groups, self.parts, self.held = {}, [], {}, [], 0

    def add(self, group: tuple, text: bytes) -> None:
        words = text.translate(LETTERS).split()
        if not words:
            return
        for word in set(words).difference(self.terms):
            self.terms[word] = len(self.terms)
            digest = xxhash.xxh3_64_intdigest(word) & self.mask
            self.digests.append(digest - (1 << 64) if digest >> 63 else digest)
        place = self.groups.setdefault(group, len(self.groups))
        term, count = np.unique(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.parts.append((term | place << 32, count, np.ones(len(term), np.int64)))
        self.held += len(term)

    def full(self) -> bool:
        if self.held > HELD:
            self.fold()
        return len(self.terms) > TERMS or self.held > HELD

    def fold(self) -> None:
        if self.parts:
            keys, *sums = (np.concatenate(column) for column in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.parts = [(keys[start], *(np.add.reduceat(s[order], start) for s in sums))]
            self.held = len(start)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        if self.parts:
            keys, counts, docs = self.parts[0]
            group, term = keys >> 32, keys & 0xFFFFFFFF
            named = np.ones(len(term), bool)
            if not self.every:
                named[:] = False
                named[np.unique(term, return_index=True)[1]] = True
            langs, sources = (pa.array(list(names), pa.string()) for names in zip(*self.groups))
            texts = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            digests = np.array(self.digests, np.int64)
            for i in range(0, len(term), 1 << 16):
                s = slice(i, i + (1 << 16))
                columns = [
                    langs.take(pa.array(group[s])),
                    sources.take(pa.array(group[s])),
                    pa.array(digests[term[s]]),
                    pa.array(counts[s]),
                    pa.array(docs[s]),
                    texts.take(pa.array(term[s], mask=~named[s])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "count", "docs", "term"])
        self.clear()


def term_counts(docs: DataFrame, bits: int = BITS, every: bool = False) -> DataFrame:
    """lang, source, digest, count, docs of groups, by task; ``term`` at its first row only or, with ``every``, at all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bits, every)
        for batch in slices(batches):
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group, text in zip(groups, as_bytes(batch.column(2))):
                counts.add(group, text)
                if counts.full():
                    yield from counts.rows()
        yield from counts.rows()

    return docs.mapInArrow(task, "lang string, source string, digest bigint, count bigint, docs bigint, term string")


def numbered_terms(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, split, count, docs) and texts (digest, split, term).

    ``split`` is 0 where a digest stands for one term, and otherwise numbers its terms.
    """
    rows = staged(term_counts(docs, bits), "term-counts")
    texts = rows.filter("term is not null").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("_last"))
    texts = staged(texts, "term-texts")
    mixed = texts.filter("term != _last").select("digest")
    single = texts.filter("term = _last").select("digest", F.lit(0).alias("split"), "term")
    columns = ["lang", "source", "digest", "split", "count", "docs"]
    if mixed.isEmpty():
        return rows.withColumn("split", F.lit(0)).select(*columns), single
    again = staged(term_counts(docs, bits, every=True).join(mixed, "digest", "left_semi"), "mixed-terms")
    order = Window.partitionBy("digest").orderBy("term")
    numbers = staged(again.select("digest", "term").distinct().withColumn("split", F.row_number().over(order)), "split-terms")
    clear = rows.join(mixed, "digest", "left_anti").withColumn("split", F.lit(0))
    parted = again.join(numbers, ["digest", "term"])
    return clear.select(*columns).unionByName(parted.select(*columns)), single.unionByName(numbers.select("digest", "split", "term"))


def share_sql(count: str, total: str, terms: str) -> str:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * terms)) in longs, three digits at a time: exact below 9e15."""
    whole, rest = f"({total} + 2 * {terms})", f"({count} + 2)"
    digits, out = [], []
    for power in (WHOLE, 1_000_000, 1_000, 1):
        digits.append(f"({rest} div {whole}) * {power}L")
        rest = f"(({rest} % {whole}) * 1000L)"
        out = digits
    return "1L + " + " + ".join(out)


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same in numpy."""
    whole, rest = total + 2 * terms, count + 2
    out = np.ones(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for power in (WHOLE, 1_000_000, 1_000, 1):
        out += rest // whole * power
        rest = rest % whole * 1000
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare(key: tuple, cells: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms for the pairs of sources of two tiles."""
    lang, _, low, high = key
    sides = sides.sort_values("source").reset_index(drop=True)
    terms = int(sides["v"].iloc[0])
    place = dict(zip(sides["source"], range(len(sides))))
    digests = cells[["digest", "split"]].to_numpy(np.int64).reshape(-1, 2)
    seen, row = np.unique(digests, axis=0, return_inverse=True) if len(digests) else (digests, np.empty(0, int))
    counts = np.zeros((len(seen), len(sides)), np.int64)
    counts[row.reshape(-1), cells["source"].map(place).to_numpy(np.int64)] = cells["count"].to_numpy(np.int64)
    total = sides["n"].to_numpy(np.int64)
    p, none = counts, np.ones(len(sides), np.int64)
    if terms:
        p, none = share(counts, total[None, :], terms), share(np.zeros(len(sides), np.int64), total, terms)
    first = np.flatnonzero(sides["tile"].to_numpy() == low)
    second = first if low == high else np.flatnonzero(sides["tile"].to_numpy() == high)
    names = sides["source"].to_numpy()
    ways = [(i, second[second > i] if low == high else second) for i in first]
    empty = np.empty(0, np.int64)
    a = np.concatenate([empty, *(np.full(len(others), i) for i, others in ways)])
    b = np.concatenate([empty, *(others for _, others in ways)])
    values = [distance(p[:, i : i + 1], p[:, others]).sum(axis=0) for i, others in ways]
    return pd.DataFrame(
        {
            "lang": lang,
            "a": names[a],
            "b": names[b],
            "part_value": np.concatenate([empty, *values]),
            "seen": len(seen),
            "unseen_value": distance(none[a], none[b]),
            "v": terms,
        }
    )


def pairs(kept: DataFrame, groups: DataFrame, block: int, tile: int) -> DataFrame:
    """Each ordered pair of sources of a language (source, item) and its value."""
    # One row a language: tiles of its sources, blocks of its terms.
    cut = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("_tiles"), F.greatest(F.lit(1), F.ceil(F.max("v") / block)).cast("int").alias("_blocks")
    )
    cut = staged(cut, "comparing-tiles")
    own = F.pmod(F.xxhash64("source"), F.col("_tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    keys = ["lang", "_block", "_low", "_high"]

    def tiled(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("tile", own).withColumn("_other", other)
        return out.withColumn("_low", F.least("tile", "_other")).withColumn("_high", F.greatest("tile", "_other"))

    cells = kept.join(cut, "lang").withColumn("_block", F.pmod(F.xxhash64("digest", "split"), F.col("_blocks")).cast("int"))
    cells = tiled(cells).select(*keys, "source", "digest", "split", "count")
    sides = groups.join(cut, "lang").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sides = tiled(sides).select(*keys, "source", "tile", "n", "v")
    schema = "lang string, a string, b string, part_value long, seen long, unseen_value long, v long"
    sums = cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(compare, schema)
    value = F.sum("part_value") + (F.first("v") - F.sum("seen")) * F.first("unseen_value")
    both = sums.groupBy("lang", "a", "b").agg(value.alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return both.select("lang", F.inline(ways), "value")


def divergence(docs: DataFrame, *, bits: int = BITS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank: pairs of sources, and the terms that a source has most above its language.

    Each row is a document. Null texts, languages and sources count as empty; a group without terms is compared
    all the same, and where a language keeps no term its pairs have the value 0. Repeated rows count each. Texts of
    any length are counted where they are read. Other columns are ignored. An empty table gives no rows. ``bits`` is the
    width of a digest; results are the same at any width. Ties are ordered by item.
    """
    docs = doc_rows(docs, "lang", "source", "text").select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text"
    )
    rows, texts = numbered_terms(docs, bits)
    counts = staged(rows.groupBy("lang", "source", "digest", "split").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "group-terms")
    totals = counts.groupBy("lang", "digest", "split").agg(F.sum("count").alias("total"), F.sum("docs").alias("_docs"))
    totals = staged(totals.filter(F.col("_docs") >= LEAST).drop("_docs"), "kept-terms")
    kept = staged(counts.drop("docs").join(totals, ["lang", "digest", "split"]), "kept-counts")
    langs = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    held = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(held, ["lang", "source"], "left")
    groups = staged(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "n_lang", "n"))), "term-groups")

    ranked = pairs(kept, groups, block, tile).withColumn("part", F.lit("pair"))
    by_group = Window.partitionBy("lang", "source")
    order = by_group.orderBy(F.desc("value"), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(order))

    above = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "digest", "split", F.expr(share_sql("count", "n", "v")).alias("p"), F.expr(share_sql("total", "n_lang", "v")).alias("q")
    )
    above = above.filter("p > q").selectExpr("lang", "source", "digest", "split", "(p - q) * (p - q) div (p + q) as value")
    # Ties at the last rank stay until their texts are known.
    top = staged(above.withColumn("_rank", F.rank().over(by_group.orderBy(F.desc("value")))).filter(F.col("_rank") <= TOP), "top-terms")
    named = top.join(texts, ["digest", "split"]).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    named = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(named.select(*columns))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (
  SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS total FROM o GROUP BY ALL HAVING count(*) >= {LEAST}
), l AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(sum(o.n), 0)::HUGEINT AS n
  FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term GROUP BY ALL
), p AS (
  SELECT c.lang, source, term, c.n AS own,
         1 + ({WHOLE}::HUGEINT * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, source)::HUGEINT + 2 * v) AS p,
         1 + ({WHOLE}::HUGEINT * (total + 2)) // (l.n + 2 * v) AS q
  FROM c JOIN l USING (lang)
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE own > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
