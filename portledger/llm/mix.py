"""Mixing sources to target weights by iterative proportional fitting.

Words are counted in cells of source, language and topic. Each of the three has target shares; one
factor a source, a language and a topic is fitted in turn so that the cells, weighted by their three factors, add
up to the targets. A document stays with a probability in proportion to its cell's weight, the largest
being one, so the expected words of the sample have the target shares.

Where that would keep less than ``KEPT`` of the words, because a small group sets the scale, ``drawn`` holds to
that budget: groups with fewer words than they should give stay whole, the others share the rest by their targets,
and cells that reach the probability one stay there while the rest is fitted again.

Everything here is DataFrame functions. Documents are aggregated to cells before anything else; factors are
written after each step, which ends their lineage, and joins are left to the planner, which broadcasts by size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import SPACE_CLASS
from portledger.sources.staging import staged

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the shares of words to this power, made to add up to one: below 1, large groups give way.
POWERS = {"source": 0.8, "lang": 0.95, "topic": 1.0}
ROUNDS = 6
#: Share of the words that ``drawn`` keeps at least.
KEPT = 0.9
SEED = "mix"
NOT_SPACE = SPACE_CLASS.replace("[", "[^", 1) + "+"


def topic(text: Column) -> Column:
    """What kind of text it is, by its characters."""
    size = F.char_length(text)

    def share(kept: str) -> Column:
        return size - F.char_length(F.translate(text, kept, ""))

    return (
        F.when(share("|*#$%&!") * 20 >= size + 1, "marked")
        .when(share("0123456789") * 20 >= size + 1, "figures")
        .when(size < 400, "brief")
        .when(size < 4000, "medium")
        .otherwise("long")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _words and _draw, a number in [0, 1) fixed by the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_topic": topic(text),
            "_words": F.regexp_count(text, F.lit(NOT_SPACE)).cast("long"),
            "_draw": F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0,
        }
    )


def targets(cells: DataFrame, name: str, power: float) -> DataFrame:
    """Key, target share and a first factor of one dimension."""
    words = cells.groupBy(name).agg(F.sum("words").alias("_n"))
    parts = words.select(name, F.pow("_n", F.lit(power)).alias("_p"))
    whole = parts.agg(F.sum("_p")).first()[0] or 1.0
    return parts.select(name, (F.col("_p") / F.lit(float(whole))).alias(f"{name}_target"), F.lit(1.0).alias(f"{name}_factor"))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int) -> dict[str, DataFrame]:
    """Factors of each dimension after so many rounds; a group without words keeps the factor one."""
    whole = cells.agg(F.sum("words")).first()[0] or 1
    shares = staged(cells.withColumn("share", F.col("words") / F.lit(float(whole))), "mix-cells")
    factors = {name: staged(targets(cells, name, powers[name]), f"mix-{name}") for name in DIMENSIONS}
    for _ in range(rounds):
        for name in DIMENSIONS:
            others = [other for other in DIMENSIONS if other != name]
            weighted = reduce(lambda df, o: df.join(factors[o].drop(f"{o}_target"), o), others, shares)
            product = reduce(lambda a, b: a * b, [F.col(f"{o}_factor") for o in others], F.col("share"))
            now = weighted.groupBy(name).agg(F.sum(product).alias("_now"))
            fitted = factors[name].drop(f"{name}_factor").join(now, name)
            factor = F.when(F.col("_now") > 0, F.col(f"{name}_target") / F.col("_now")).otherwise(1.0)
            factors[name] = staged(fitted.select(name, f"{name}_target", factor.alias(f"{name}_factor")), f"mix-{name}")
    return factors


def weights(described_docs: DataFrame, powers: dict[str, float], rounds: int) -> tuple[DataFrame, float]:
    """Cells with their words and fitted _weight, and the largest weight of a cell with words."""
    keys = [F.col(f"_{name}").alias(name) for name in DIMENSIONS]
    cells = staged(described_docs.groupBy(*keys).agg(F.sum("_words").alias("words")), "mix-cells")
    factors = rake(cells, powers, rounds)
    weighted = reduce(lambda df, name: df.join(factors[name].drop(f"{name}_target"), name), DIMENSIONS, cells)
    product = reduce(lambda a, b: a * b, [F.col(f"{name}_factor") for name in DIMENSIONS])
    weighted = staged(weighted.select(*DIMENSIONS, "words", product.alias("_weight")), "mix-weights")
    return weighted, float(weighted.filter("words > 0").agg(F.max("_weight")).first()[0] or 1.0)


def rates(described_docs: DataFrame, powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Probability of each cell: _source, _lang, _topic and _rate."""
    weighted, most = weights(described_docs, powers or POWERS, rounds)
    return as_rates(weighted, F.col("_weight") / F.lit(most))


def as_rates(cells: DataFrame, rate: Column) -> DataFrame:
    return cells.select(*(F.col(name).alias(f"_{name}") for name in DIMENSIONS), F.least(F.lit(1.0), rate).alias("_rate"))


def wanted(cells: DataFrame, name: str, power: float, budget: float) -> DataFrame:
    """Words each group should give: its target's part of ``budget``, or all of them where it has fewer."""
    groups = staged(cells.groupBy(name).agg(F.sum("words").alias("_n")).withColumn("_p", F.pow("_n", F.lit(power))), f"mix-{name}")
    scale = 0.0
    while True:
        whole = F.col("_p") * F.lit(scale) >= F.col("_n")
        sums = groups.agg(F.sum(F.when(whole, F.col("_n")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("_p")))).first()
        after = (budget - sums[0]) / sums[1] if sums[1] else scale
        if after <= scale * (1 + 1e-9):
            return groups.select(name, F.least(F.col("_n").cast("double"), F.col("_p") * F.lit(scale)).alias("_wanted"))
        scale = after


def budgeted(described_docs: DataFrame, kept: float = KEPT, powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """As ``rates``, but at least ``kept`` of the words are expected to stay."""
    powers = powers or POWERS
    cells, most = weights(described_docs, powers, rounds)
    whole, now = cells.agg(F.sum("words"), F.sum(F.col("words") * F.col("_weight"))).first()
    if not whole or now / most >= kept * whole:
        return as_rates(cells, F.col("_weight") / F.lit(most))
    aims = {name: staged(wanted(cells, name, powers[name], kept * whole), f"mix-{name}") for name in DIMENSIONS}
    cells = cells.withColumn("_weight", F.col("_weight") * F.lit(kept * whole / now))
    for _ in range(rounds):
        for name in DIMENSIONS:
            free = F.col("_weight") < 1
            sums = cells.groupBy(name).agg(
                F.sum(F.when(free, F.col("words") * F.col("_weight")).otherwise(0.0)).alias("_free"),
                F.sum(F.when(free, 0).otherwise(F.col("words"))).alias("_held"),
            )
            ratio = (
                F.when((F.col("_free") > 0) & (F.col("_wanted") > F.col("_held")), (F.col("_wanted") - F.col("_held")) / F.col("_free"))
                .when(F.col("_free") + F.col("_held") > 0, F.col("_wanted") / (F.col("_free") + F.col("_held")))
                .otherwise(1.0)
            )
            steps = sums.join(aims[name], name).select(name, ratio.alias("_step"))
            cells = staged(cells.join(steps, name).select(*DIMENSIONS, "words", (F.col("_weight") * F.col("_step")).alias("_weight")), "mix-held")
    return as_rates(cells, F.col("_weight"))


def sampled(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, words, probability and kept of every row.

    ``docs`` needs doc_id, text, source and lang; other columns are ignored. Null sources, languages and
    texts count as empty strings; rows of one id are drawn alike, rows without an id too. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "source", "lang")
    rows = staged(described(rows).select("doc_id", *(f"_{n}" for n in DIMENSIONS), "_words", "_draw"), "mix-rows")
    return rows.join(rates(rows), [f"_{name}" for name in DIMENSIONS]).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_words").alias("words"),
        F.round("_rate", 6).alias("probability"),
        (F.col("_draw") < F.col("_rate")).alias("kept"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents drawn, with all their columns."""
    return with_rates(docs, rates)


def drawn(docs: DataFrame) -> DataFrame:
    """The documents drawn within the budget of words, with all their columns."""
    return with_rates(docs, budgeted)


def with_rates(docs: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = described(docs)
    names = [f"_{name}" for name in DIMENSIONS]
    kept = rows.join(of(rows.select(*names, "_words")), names).filter("_draw < _rate")
    return kept.select(*(f"`{c}`" for c in docs.columns))


def sql(rounds: int = ROUNDS) -> str:
    """The same in SQL, round by round."""
    parts = [
        r"""d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         length(coalesce(text, '')) AS size FROM documents
), t AS MATERIALIZED (
  SELECT doc_id, source, lang,
         CASE WHEN (size - length(translate(text, '|*#$%&!', ''))) * 20 >= size + 1 THEN 'marked'
              WHEN (size - length(translate(text, '0123456789', ''))) * 20 >= size + 1 THEN 'figures'
              WHEN size < 400 THEN 'brief' WHEN size < 4000 THEN 'medium' ELSE 'long' END AS topic,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM d
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(words)::DOUBLE AS words, sum(words) / sum(sum(words)) OVER ()::DOUBLE AS share
  FROM t GROUP BY ALL
)"""
    ]
    for name, power in POWERS.items():
        parts.append(
            f"{name}_t AS MATERIALIZED (SELECT {name}, pow(sum(words), {power}) / sum(pow(sum(words), {power})) OVER () AS target "
            f"FROM cells GROUP BY {name})"
        )
        parts.append(f"{name}_0 AS MATERIALIZED (SELECT {name}, 1.0::DOUBLE AS f FROM {name}_t)")
    latest = {name: f"{name}_0" for name in DIMENSIONS}
    for i in range(1, rounds + 1):
        for name in DIMENSIONS:
            a, b = (latest[o] for o in DIMENSIONS if o != name)
            oa, ob = (o for o in DIMENSIONS if o != name)
            parts.append(
                f"{name}_{i} AS MATERIALIZED (SELECT {name}, CASE WHEN sum(share * a.f * b.f) > 0 "
                f"THEN any_value(target) / sum(share * a.f * b.f) ELSE 1 END AS f FROM cells JOIN {a} a USING ({oa}) "
                f"JOIN {b} b USING ({ob}) JOIN {name}_t USING ({name}) GROUP BY {name})"
            )
            latest[name] = f"{name}_{i}"
    joins = " ".join(f"JOIN {latest[name]} {name}_f USING ({name})" for name in DIMENSIONS)
    parts.append(f"w AS MATERIALIZED (SELECT source, lang, topic, words, source_f.f * lang_f.f * topic_f.f AS weight FROM cells {joins})")
    parts.append("r AS MATERIALIZED (SELECT source, lang, topic, least(1.0, weight / (SELECT max(weight) FROM w WHERE words > 0)) AS rate FROM w)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, t.words, round(rate, 6) AS probability, "
        "draw < rate AS kept FROM t JOIN r USING (source, lang, topic)"
    )
