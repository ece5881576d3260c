import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _text string, part int"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, copies, near copies, passages, repeats, white space and one long text."""
    rng = random.Random(3)
    texts = [None, "", "  \n\t ", "a", "Ab  c", "abc", "A b\nC", "ünï çödé 日本語 <|endoftext|> x", "7 8 9 !!! ??"]
    base = [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    texts += base + base[:6] + base[:3]
    for text in base[:20]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    passage = words(rng, 160)
    texts += [f"{words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(6)]
    texts += ["x" * 900, "ab " * 400, words(rng, 6000), passage + " " + passage]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names clash with ones the operators use."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None, len(t or ""), "x", "y", 1) for i, t in corpus]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
