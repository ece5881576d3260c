"""Words are cut and put together as one text a batch, whatever else is among them and however little is remembered."""

import random

import pytest

from portledger.llm import pack


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


@pytest.mark.parametrize("held", [pack.CACHE_WORDS, 40])
def test_plain_words_are_cut_together(monkeypatch, held):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(pack, "CACHE_WORDS", held)
    whole, words = tokenizers.Tokenizer.from_file(path), pack.WordIds(path)
    words.plain = Counted(words.plain)
    rng = random.Random(6)
    odd = ["日本語", "a\x1cb", "x\xa0y", "<|endoftext|>", "ǅ", "ÀÉß", "it's", "don't!!", "7½a", "İi"]
    batches = [["", " \t", *(" ".join(rng.choice([*odd, f"Wort{rng.randrange(900)},"]) for _ in range(30)) for _ in range(20))] for _ in range(3)]
    for texts in [*batches, ["plain words"], ["日本語"], [""]]:
        for text, ids in zip(texts, words.documents([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, pack.END_ID]
    assert words.plain.calls <= len(batches) + 1


class Lookups(dict):
    count = 0

    def __getitem__(self, word):
        self.count += 1
        return super().__getitem__(word)


def test_a_batch_looks_its_distinct_words_up_once():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    words = pack.WordIds(path)
    words.words = Lookups()
    texts = [b"to be or not to be " * 50, b"", b"or not", b"to\tbe\nor\x0bnot\x0cto\rbe"]
    lengths = [len(ids) for ids in words.documents(texts)]
    assert lengths == [301, 1, 3, 7]
    assert words.words.count <= 4


def test_new_pieces_are_encoded_in_one_call_without_their_places(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    words, calls = pack.WordIds(path), []

    class Model:
        def encode_batch_fast(self, given, **kinds):
            calls.append(given)
            return kept.encode_batch_fast(given, **kinds)

    kept = words.model
    monkeypatch.setattr(words, "model", Model())
    whole = words.whole
    texts = ["naïve Straße, don't! ÿ·ł §12", "Straße ¿qué? “ok”", "½ ­x naïve"]
    for text, ids in zip(texts, words.documents([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, pack.END_ID]
    assert len(calls) == 1


@pytest.mark.parametrize("seed", range(4))
def test_words_are_cut_where_bytes_split_cuts(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab\xc3 \t\n\x0b\x0c\r\x1c\x85") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(40)]
    distinct, which, counts = pack.distinct_words(texts)
    split = [text.split() for text in texts]
    assert counts.tolist() == [len(words) for words in split]
    assert [distinct[i] for i in which] == [word for words in split for word in words]
    assert len(distinct) == len({word for words in split for word in words})


def test_words_that_a_full_memory_still_needs_stay(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(pack, "CACHE_WORDS", 6)
    words, learnt = pack.WordIds(path), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learnt.append(sorted(new)), learn(new)))
    for texts in ([b"one two three four"], [b"one two five six seven"], [b"three"]):
        list(words.documents(texts))
    assert learnt == [[b"four", b"one", b"three", b"two"], [b"five", b"seven", b"six"], [b"three"]]
