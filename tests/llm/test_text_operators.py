"""The text operators against brute force on one small corpus: nulls, empty and long texts, ties, repeats,
empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from portledger.llm import chat, exact, extract, graph, jaccard, langid, mix, pack, quality, suffixes, syncmers

WHITE = "[\x20\x09-\x0D]"


def frame(df):
    return df.toPandas()


def words(rng, n, kinds):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def test_packing_places_each_id_once(docs, no_docs, corpus):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    out = frame(pack.pack(docs.union(docs.filter("doc_id = 12")), path, pool=8))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus}
    copies = {i: 2 if i == 12 else 1 for i in ids}
    seen = Counter()
    for row in out.itertuples():
        piece = np.frombuffer(row.ids, "<u4").tolist()
        assert piece == ids[row.doc_id][row.start : row.start + row.length] and row.doc_tokens == len(ids[row.doc_id])
        seen.update((row.doc_id, i) for i in range(row.start, row.start + row.length))
    assert seen == Counter({(i, j): copies[i] for i in ids for j in range(len(ids[i]))})
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        total = group.length.sum()
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]]
        assert group.sequence_length.iloc[0] == (total if total & (total - 1) == 0 else 4096) and total <= 4096
    padding = out.groupby("sequence_id").agg(n=("length", "sum"), to=("sequence_length", "first"))
    assert (padding.to - padding.n).sum() <= 0.02 * padding.n.sum()
    digests = frame(pack.piece_digests(pack.pack(docs, path)))
    assert len(digests) and set(digests.columns) == set(out.columns) - {"ids"} | {"ids_crc32"}
    one = out.iloc[0]
    assert zlib.crc32(one.ids) >= 0 and frame(pack.pack(no_docs, path)).empty


def test_exact_groups(spark, docs, no_docs, corpus):
    rows = docs.union(docs.filter("doc_id in (4, 12)")).unionByName(
        spark.createDataFrame([(None, "a bc"), (None, None)], "doc_id long, text string"), allowMissingColumns=True
    )
    out = frame(exact.exact_groups(rows))
    every = [(i, t) for i, t in corpus] + [(i, t) for i, t in corpus if i in (4, 12)] + [(None, "a bc"), (None, None)]
    groups = {}
    for i, t in every:
        groups.setdefault(re.sub(WHITE, "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    assert len(out) == len(every) and out.kept.sum() == len(groups)
    by_digest = {hashlib.sha256(n.encode()).hexdigest(): g for n, g in groups.items()}
    for row in out.itertuples():
        group = by_digest[row.text_sha256]
        _, unknown, keep = min(group)
        assert row.group_size == len(group) and (row.keep_id != row.keep_id if unknown else row.keep_id == keep)
    assert out[out.kept].text_sha256.is_unique
    assert frame(exact.exact_groups(no_docs)).empty
    stay = frame(exact.dedup(rows))
    assert list(stay.columns) == rows.columns and len(stay) == len(groups)


def test_exact_groups_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text' else concat('t', id % 700) end as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = frame(exact.exact_groups(rows.repartition(7)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = out[out.group_size == 1000]
    assert len(hot) == 1000 and set(hot.keep_id) == {0} and hot.kept.sum() == 1 and out.kept.sum() == out.text_sha256.nunique()


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|im_end|> good"),
        (1, 2, "assistant", "second <\\|im_end|> é 日本"),
        (1, 1, "user", None),
        (1, 3, "assistant", ""),
        (1, 3, "assistant", ""),
        (2, None, None, "no role"),
        (None, 0, "user\nx", "<|im_sep|>" * 3),
        (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"),
        (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as ids", "1 as formatted")
    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    formatted = chat.format_turns(turns.repartition(3), ranks)
    for row in formatted.collect():
        assert row.ids[0] == chat.START_ID and row.ids[-1] == chat.END_ID and len(row.ids) == len(row.loss_mask)
        assert row.formatted.count(chat.START) == row.formatted.count(chat.END) == 1
    out = {r.conv_id: r for r in chat.conversation_digests(chat.read_turns(formatted, ranks)).collect()}
    for conv in (1, 2, None, -1):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert out[conv].n_turns == len(mine) and out[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert out[conv].loss_chars == len(loss) and out[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(out) == 4
    assert chat.format_turns(turns.limit(0), ranks).count() == 0


def shingle_set(text, n):
    split = [w for w in re.split(WHITE + "+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(split[i : i + n]) for i in range(max(1, len(split) - n + 1))} if split else set()


@pytest.mark.parametrize(("n", "percent", "held", "written"), [(3, 90, 16, True), (5, 80, 16, False), (2, 60, 3, True)])
def test_jaccard_classes(docs, no_docs, corpus, n, percent, held, written):
    out = {r.doc_id: r for r in jaccard.jaccard_classes(docs, n, percent, held, written=written).collect()}
    sets = {i: shingle_set(t, n) for i, t in corpus}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in out.items()} == {i: find(i) for i in sets}
    assert {i: r.n_shingles for i, r in out.items()} == {i: len(s) for i, s in sets.items()}
    assert jaccard.jaccard_classes(no_docs, written=written).count() == 0


def test_jaccard_chain_needs_the_second_round(spark):
    """Each text is near the next alone, so stars around the smallest id do not show every link."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(8):
        rows.append((7 - step, " ".join(base)))
        for i in range(6):
            base[(step * 25 + i) % 200] = f"x{step}-{i}"
    rows += [(None, rows[0][1]), (3, rows[4][1]), (50, None), (51, "")]
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 3).collect()
    assert {r.component_id for r in out if r.doc_id is not None and r.doc_id < 8} == {0}
    assert len(out) == len(rows) and {r.component_id for r in out if r.doc_id in (50, 51)} == {50, 51}
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 3).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 50, 51]


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(100, 101), (101, 101)], "a long, b long"))
    out = {r.node: r.component for r in graph.components(links).collect()}
    assert out == {i: 0 for i in range(60)} | {100: 100, 101: 100}


def test_language_and_quality(spark, no_docs):
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        text = " ".join(["the quick brown fox and", "der schnelle braune fuchs und"][i % 2] for _ in range(1 + i % 40))
        if i % 4 == 0:
            text = " ".join(w + "!!!" for w in text.upper().split())
            labels.append((i, 0))
        else:
            labels.append((i, 1))
        rows.append((i, text, lang))
    rows += [(500, None, "en"), (501, "123 !!", "en"), (502, "the fox and the brown", None), (None, "der fuchs und", "de"), (3, rows[3][1], "de")]
    labels += [(None, 1), (7, None), (1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "1 as lang_pred")
    out = langid.identify(docs).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    own = out[out.doc_id < 160].drop_duplicates("doc_id").set_index("doc_id")
    assert (own.lang_pred == [("en", "de")[int(i) % 2] for i in own.index]).mean() > 0.98
    assert set(out[out.doc_id.isin([500, 501])].lang_pred) == {"und"}
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out, strict=True) if i == i)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (500, 501)").count() == 0 and kept.count() > 150
    marks = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'x' as text")
    scored = quality.classify(docs, marks).toPandas()
    good = scored[(scored.doc_id < 160) & scored.held_out].drop_duplicates("doc_id")
    assert ((good.doc_id % 4 != 0).astype(int) == good.predicted).mean() > 0.95
    assert len(scored) == len(rows) and scored.score.between(0, 1).all()
    assert langid.identify(no_docs).count() == 0 and quality.classify(no_docs, marks).count() == 0
    unknown = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).toPandas()
    assert set(unknown.lang_pred) == {"und"}
    assert set(quality.classify(docs, marks.limit(0)).toPandas().score) == {0.5}


def test_fingerprints_of_neighbours(spark, docs, no_docs, corpus):
    texts = [t or "" for _, t in corpus]
    out = syncmers.fingerprints(docs, parts=7).toPandas().sort_values("doc_id")
    assert len(out) == len(texts)
    for i, row in enumerate(out.itertuples()):
        after = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + after[:half]
        assert row.n_chars == len(texts[i]) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == syncmers.as_text(syncmers.fingerprint(texts[i].encode()))
        assert 0 <= row.near_edited <= 1 and (row.near_next == 1) >= (texts[i] == after)
    assert syncmers.fingerprints(no_docs).count() == 0
    odd = [(None, "b"), (None, "a"), (5, "five"), (5, "cinq"), (9, None)]
    found = syncmers.fingerprints(spark.createDataFrame(odd, "doc_id long, text string"), parts=3).collect()
    assert len(found) == 5 and [r.doc_id for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [5, 5, 9, None, None]
    assert syncmers.fingerprints(spark.createDataFrame(odd[:2], "doc_id long, text string"), parts=3).count() == 2


def test_extract_edges(spark):
    rows = [(1, "u", "<article><p>Hello there, dear reader of this.</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "2 as n_chars")
    out = extract.extract(pages).collect()
    assert len(out) == 4 and {r.n_chars for r in out if r.text == ""} <= {0}
    assert next(r.text for r in out if r.page_id == 1 and r.n_chars > 5) == "Hello there, dear reader of this."
    assert extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("length", "k", "group"), [(400, 50, 1 << 18), (60, 12, 1 << 18), (60, 12, 200)])
def test_repeated_strings(docs, no_docs, corpus, length, k, group):
    rows = docs.union(docs.filter("doc_id = 30"))
    every = [(i, (t or "").encode()) for i, t in corpus] + [(i, (t or "").encode()) for i, t in corpus if i == 30]
    seen = Counter(t[i : i + length] for _, t in every for i in range(len(t) - length + 1))
    want = Counter()
    for i, t in every:
        steps = np.zeros(len(t) + 1, int)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                steps[j] += 1
                steps[j + length] -= 1
        out = np.cumsum(steps[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~out])
        want[(i, len(t), int(out.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffixes.remove_repeats(rows, length, k, group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    if group > 200:
        assert suffixes.remove_repeats(no_docs, length, k).count() == 0


def test_repeated_strings_of_repeated_rows(spark):
    """Hundreds of equal rows, with and without an id, cost no more than one; what they share with others goes too."""
    rng = random.Random(9)
    long, other = (words(rng, 4000, 10**6) for _ in range(2))
    rows = [(7, long)] * 300 + [(None, other)] * 300 + [(8, "x " + long[500:2000] + " y"), (None, "z" * 100), (9, words(rng, 300, 10**6))]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.n_bytes in (len(long), len(other)):
            assert (r.n_removed, r.n_spans, r.kept_sha256) == (r.n_bytes, 1, hashlib.sha256(b"").hexdigest())
        elif r.doc_id == 8:
            assert (r.n_removed, r.n_spans) == (1500, 1)
        else:
            assert (r.n_removed, r.n_spans) == (0, 0)


def test_passages_shorter_than_the_length_stay(spark):
    """Passages of over 50 words but under 400 bytes that many documents share are no repeats of 400 bytes."""
    rng = random.Random(12)
    short, long = " ".join(f"w{i % 10}" + "abc"[i % 3] for i in range(60)), words(rng, 120, 10**6)
    assert len(short) < 400 < len(long)
    rows = [(i, f"{words(rng, 50, 10**6)} {short if i % 2 else long} {words(rng, 50, 10**6)}") for i in range(12)]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The blanks around a passage are shared as well.
    assert {(r.n_removed, r.n_spans) for r in found if r.doc_id % 2} == {(0, 0)}
    assert all(r.n_spans == 1 and len(long) <= r.n_removed <= len(long) + 4 for r in found if r.doc_id % 2 == 0)


def test_mixing_meets_targets_and_sql(spark, docs, no_docs):
    out = mix.sampled(docs).toPandas()
    assert len(out) == docs.count() and out.probability.between(0, 1).all() and out.probability.max() == 1
    source = out.assign(w=out.words * out.probability).groupby("source").w.sum()
    aim = out.groupby("source").words.sum() ** mix.POWERS["source"]
    assert np.allclose(source / source.sum(), aim / aim.sum(), atol=0.02)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    key = ["doc_id", "words", "topic"]
    want = con.execute(mix.sql()).df().sort_values(key).reset_index(drop=True)
    got = out[list(want.columns)].sort_values(key).reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))
    assert mix.sampled(no_docs).count() == 0
    kept = mix.mixed(docs)
    assert kept.columns == docs.columns and kept.count() == int(out.kept.sum())


def test_mixing_plan_is_native(docs):
    plan = mix.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_mixing_keeps_its_budget_beside_a_tiny_source(spark):
    """One short document of a new source must not set the scale for all others."""
    rows = [(i, "abc " * (50 + i % 40), ("en", "de")[i % 2], ("hot", "a", "b")[i % 7 % 3]) for i in range(600)]
    rows += [(900, "one short text of twenty words " * 3, "en", "rare"), (901, None, "fr", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mix.described(docs).select(*(f"_{n}" for n in mix.DIMENSIONS), "_words")
    names = [f"_{n}" for n in mix.DIMENSIONS]

    def shares(of):
        return cells.join(of(cells), names).selectExpr("*", "_words * _rate as _kept").toPandas()

    small, out = shares(mix.rates), shares(mix.budgeted)
    assert small._kept.sum() < 0.5 * small._words.sum()
    assert 0.89 * out._words.sum() < out._kept.sum() and out._rate.between(0, 1).all()
    assert out[out._source == "rare"]._rate.min() == 1
    part = {n: out.groupby(f"_{n}")[["_words", "_kept"]].sum() for n in mix.DIMENSIONS}
    hot, others = part["source"].loc["hot"], part["source"].loc[["a", "b"]]
    assert hot._kept / hot._words < (others._kept / others._words).min()
    assert mix.drawn(docs).columns == docs.columns and mix.drawn(docs).count() > 0.8 * len(rows)
    assert mix.drawn(docs.limit(0)).count() == 0


def test_mixing_budget_leaves_kind_corpora_alone(spark):
    docs = spark.createDataFrame([(i, "some words of a text", "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    assert mix.drawn(docs).count() == 20


def test_known_languages_keep_mixed_and_unlabelled_texts(spark):
    phrases = ("the quick brown fox and", "der schnelle braune fuchs und", "le renard brun rapide et")
    rows = [(i, " ".join([phrases[i % 3]] * (5 + i % 20)), ("en", "de", "fr")[i % 3]) for i in range(150)]
    mixed = " ".join(" ".join([p] * n) for p, n in zip(phrases, (45, 35, 20), strict=True))
    rows += [(900 + i, mixed, "en") for i in range(8)] + [(950, "日本語の文章です", None), (951, "12 !?", "en"), (952, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {r.doc_id: r.score for r in langid.identify(docs).collect()}
    assert scores[901] < 1
    want = {r[0] for r in rows} - {951, 952}
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == want
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.doc_id for r in langid.keep_known(bare).collect()} == want
