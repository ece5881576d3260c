"""Scores and pipeline stages against plain Python that shares no code with them."""

import math
import re

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from portledger.llm import langid, quality, queries

M64 = (1 << 64) - 1


def plain_score(text, weights):
    """Counts of hashed words and word pairs, log-scaled to length one, times the weights."""

    def hashed(token):
        return xxhash.xxh3_64_intdigest(token.encode()) >> 1

    tokens = []
    for word in text.encode().split():
        for token in re.findall(r"[^\W\d_]+|\d|[^\w\s]+|_+", word.decode()):
            tokens.append(hashed(token.lower()))
            if len(token) > 1 and token != token.lower() and token == token.upper():
                tokens.append(hashed("^"))
    counts = {}
    for t in tokens:
        n = (t * 0xD6E8FEB86659FD93 & M64) >> 46
        counts[n] = counts.get(n, 0) + 1
    for a, b in zip(tokens, tokens[1:]):
        n = 1 if a == b else (((a * 0x9E3779B97F4A7C15 & M64) ^ b) * 0xD6E8FEB86659FD93 & M64) >> 46
        counts[n] = counts.get(n, 0) + 1
    counts.pop(0, None)
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1
    total = weights[0] + sum(weights[n] * math.log1p(c) / length for n, c in counts.items())
    return 1 / (1 + math.exp(-total))


def test_quality_scores(spark, docs, corpus):
    weights = np.random.default_rng(2).normal(0, 1, 1 << quality.BITS).astype(np.float32)
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert got.keys() == {i for i, _ in corpus}
    for i, text in corpus:
        assert math.isclose(got[i], plain_score(text or "", weights), rel_tol=1e-4), i


def plain_probabilities(network, text):
    """One window after the other, one place after the other."""
    total, used = np.zeros(len(network.languages)), 0
    data = text.encode().translate(langid.FOLD)
    for begin in range(0, len(data), 256):
        window = data[begin : begin + 256]
        padded = [network.embed[b].astype(float) for b in window + bytes(260 - len(window))]
        best = np.full(48, -np.inf)
        for at in range(256):
            for f in range(48):
                width = (2, 3, 4)[f // 16]
                answer = sum(padded[at + t] @ network.filters[8 * t : 8 * t + 8, f] for t in range(width))
                best[f] = max(best[f], answer)
        hidden = np.maximum(best + network.shift, 0)
        out = np.exp(hidden @ network.out + network.bias)
        total, used = total + out / out.sum() * len(window), used + len(window)
    return total / used


def test_language_probabilities(spark):
    network = langid.Network.fresh(["a", "b", "c"])
    network.filters *= 3
    texts = ["ein Satz", "Ünï 日本 12", "word " * 90, "x", "", None, "12 ! 7"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in langid.predict(rows, network).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r._lang_pred, r._lang_score) == ("und", 0)
            continue
        want = plain_probabilities(network, r.text)
        assert r._lang_pred == network.languages[int(want.argmax())] and math.isclose(r._lang_score, want.max(), rel_tol=1e-3)


WHITE = re.compile("[\x20\x09-\x0d]+")


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    """Each stage's rows from the rows of the one before, the last one's ids from the texts."""
    texts = dict(corpus)
    now, stages = docs.select("doc_id", "text", "lang", "source", "n_chars"), dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(texts[i] == t for i, t in kept[name].items()) and now.count() == len(kept[name])

    want = {i for i, t in corpus if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) == want

    groups = {}
    for i in want:
        groups.setdefault(WHITE.sub("", texts[i]), []).append((-len(texts[i]), i))
    want = {min(rows)[1] for rows in groups.values()}
    assert set(kept["exact_dedup"]) == want

    sets = {}
    for i in want:
        words = [w for w in WHITE.split(texts[i].translate({c: c + 32 for c in range(65, 91)})) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(kept["near_dedup"]) == {i for i in sets if find(i) == i}

    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and len(kept["mixing"]) >= 0.5 * len(kept["near_dedup"])
    whole, pieces = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), {}
    for r in stages["packing"](spark, now, "").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in kept["mixing"].items():
        ids = [x for _, part in sorted(pieces.pop(i)) for x in part]
        assert ids == [*whole.encode(t, add_special_tokens=False).ids, 2]
    assert not pieces
