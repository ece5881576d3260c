"""Parts of the text operators that need no Spark."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from portledger.llm import chat, extract, jaccard, langid, pack, quality, queries, suffixes, syncmers


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 80))
def test_closest_fill_is_the_best_sum(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    taken = pack.closest_fill(counts, capacity)
    assert all(0 < n <= counts[length] for length, n in taken.items())
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="<|\\>im_startsependoftextx ", max_size=60))
def test_escape_is_reversible_and_hides_control(text):
    assert chat.unescape(chat.escape(text)) == text
    for control in (chat.START, chat.BREAK, chat.END, "<|endoftext|>"):
        assert control not in chat.escape(text)
        assert chat.unescape(chat.escape(text + control)) == text + control


def test_mask_is_a_running_sum():
    ids, mask, begin = chat.assemble([[1], [2, 3]], [[4, 5], [6]], [False, True])
    assert ids.tolist() == [chat.START_ID, 1, chat.BREAK_ID, 4, 5, chat.END_ID, chat.START_ID, 2, 3, chat.BREAK_ID, 6, chat.END_ID]
    assert ids[mask].tolist() == [6] and begin.tolist() == [0, 6, 12]


@settings(deadline=None, max_examples=150)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), st.randoms(use_true_random=False))
def test_two_stage_order_is_the_suffix_order(text, rng):
    wanted = np.array([rng.random() < 0.6 for _ in text])
    order = suffixes.suffix_order(text, wanted)
    found = [int(i) for i in order if i < len(text) and wanted[i]]
    assert found == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:] + b"\x00\xff")


def test_equal_strings_share_a_bucket():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 107) for _ in range(500))
    finder = suffixes.Buckets()
    keys = []
    for _ in range(2):
        text = bytes(rng.randrange(97, 107) for _ in range(rng.randrange(300))) + passage + b"tail" * 5
        at = text.index(passage)
        keys.append([next(k for k, _, s, n, _ in finder.runs(text) if s <= at + i < s + n) for i in range(100)])
    assert keys[0] == keys[1]
    random_text = bytes(rng.randrange(256) for _ in range(20_000))
    runs = list(finder.runs(random_text))
    assert 60 < len({run[0] for run in runs}) < 200 and sum(run[3] for run in runs) == len(random_text) - 399


@settings(deadline=None, max_examples=300)
@given(st.integers(2, 400), st.integers(0, 30), st.integers(0, 30), st.sampled_from([80, 90]), st.sampled_from([2, 9, 16]), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(size, less, more, percent, held, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    b = np.concatenate([a[min(less, size - 1) :], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both):
        signatures = jaccard.Signatures(percent, held)
        equal = len(a) == len(b) == both
        assert equal or set(signatures(np.unique(a)).tolist()) & set(signatures(np.unique(b)).tolist())


def test_few_signatures_say_nothing_of_a_set():
    """Sets without a common feature share a signature only where cells are empty."""
    rng, signatures, shared = np.random.default_rng(4), jaccard.Signatures(80), {}
    for _ in range(400):
        for found in signatures(np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))).tolist():
            shared[found] = shared.get(found, 0) + 1
    pairs = sum(n * (n - 1) // 2 for n in shared.values())
    assert pairs <= 400 * 399 / 2 * 0.002


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 2000), st.integers(0, 300), st.integers(0, 300), st.integers(0, 10**6))
def test_sketches_differ_in_no_more_bits_than_sets(size, less, more, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    b = np.concatenate([a[min(less, size - 1) :], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
    x, y = jaccard.sketch(np.unique(a)), jaccard.sketch(np.unique(b))
    while len(x) != len(y):
        long = max(x, y, key=len)
        half = long[: len(long) // 2] ^ long[len(long) // 2 :]
        x, y = (half, y) if long is x else (x, half)
    bits = sum(int(w).bit_count() for w in (x ^ y).view(np.uint64))
    assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 60_000 + "b", "x" * 300_000, "7" * 200_000, "!" * 200_000, "é " * 100_000, "a b\tc"])
def test_long_texts_are_encoded_whole(text):
    coder = chat.encoding(queries.tokenizer("byte_bpe_50k.tiktoken"))
    ids = chat.encode(coder, text)
    assert coder.decode_bytes(ids).decode() == text
    if len(text) < 10_000 or not text.isspace() and "\n" not in text:
        assert ids == coder.encode_ordinary(text)


def test_fingerprints_follow_content():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(800))
    print_ = syncmers.fingerprint(text.encode())
    moved = syncmers.fingerprint(("intro " * 20 + text).encode())
    other = syncmers.fingerprint(" ".join(f"v{rng.randrange(5000)}" for _ in range(800)).encode())
    assert syncmers.likeness(print_, print_) == 1
    assert syncmers.likeness(print_, moved) > 0.9 and syncmers.likeness(print_, other) < 0.1
    assert np.array_equal(syncmers.from_text(syncmers.as_text(print_)), print_)
    empty = syncmers.fingerprint(b"")
    assert syncmers.likeness(empty, empty) == 1 and syncmers.likeness(empty, print_) == 0


def test_fingerprints_grow_with_the_text():
    """A passage of 200 words is found in texts of 20,000, wherever it stands; unlike texts stay unlike."""
    rng = random.Random(3)
    make = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    passage = make("p", 200)
    a, b = (syncmers.fingerprint(t.encode()) for t in (make("a", 20_000) + passage, passage + make("b", 20_000)))
    assert len(a) > 1000 and 0.002 < syncmers.likeness(a, b) < 0.05
    assert syncmers.likeness(a, syncmers.fingerprint(make("c", 20_000).encode())) < 0.001


def brute_fingerprint(text, k=12, s=4):
    """The k-mers whose smallest inner substring is the first or the last, each where it first stands."""
    out = {}
    for i in range(len(text) - k + 1):
        inner = [text[i + j : i + j + s] for j in range(k - s + 1)]
        hashes = [int(syncmers._mixed(np.frombuffer(x, "<u4").astype(np.uint64))[0]) for x in inner]
        if min(hashes) in (hashes[0], hashes[-1]):
            h = np.uint64(hashes[0])
            for part in (4, 8):
                h = syncmers._mixed(np.array([h ^ np.uint64(hashes[part])]))[0]
            out.setdefault(int(h) >> 32, i)
    kept = sorted(out.items())
    return kept[: max(64, sum(h < 2**28 for h, _ in kept))]


@settings(deadline=None, max_examples=30)
@given(st.one_of(st.binary(min_size=12, max_size=300), st.text("ab c", min_size=12, max_size=900).map(str.encode), st.integers(0, 10**6).map(lambda n: random.Random(n).randbytes(9000))))
def test_fingerprint_against_brute_force(text):
    want = brute_fingerprint(text)
    if want:
        assert [tuple(map(int, anchor)) for anchor in syncmers.fingerprint(text)] == want


def test_syncmers_do_not_depend_on_context():
    rng = random.Random(4)
    core = bytes(rng.randrange(97, 123) for _ in range(300))
    hashes, at = syncmers.syncmers(core)
    around, places = syncmers.syncmers(b"some text before " + core + b" and after")
    inside = {(int(h), int(p) - 17) for h, p in zip(around, places, strict=True) if 17 <= p <= 17 + len(core) - syncmers.K}
    assert inside == set(zip(hashes.tolist(), at.tolist(), strict=True))


def test_minimum_cut_against_all_cuts():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randrange(1, 7)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.6]

        def cost(side, odds=odds, edges=edges):
            own = sum(max(-o, 0) if s else max(o, 0) for o, s in zip(odds, side, strict=True))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(extract.content_side(odds, edges)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to improve your visit.</p></div><!-- <p>hidden</p> -->
<div class="ad">Buy now, many good things for a small price today.</div>
<main><article><h1>A &amp; B</h1><p>First   <b>bo</b>ld
text &eacute;&#x41;.<p>Second paragraph with some more words in it.<br>And a line.
<ul><li>item one<li>item two</ul></article></main>
<aside class="sidebar"><p>Read more of our other stories here.</p></aside>
<form><label>Name</label><input name=x><button>Send</button></form>
<section id="comments"><p>I do not agree with this article, says a reader at length.</p></section>
<footer>&copy; someone</footer></body>"""


def test_main_text_of_a_page():
    assert extract.main_text(PAGE) == "A & B First bold text éA. Second paragraph with some more words in it. And a line. item one item two"
    assert extract.main_text("") == "" and extract.main_text("<p") in ("", "<p")
    assert extract.main_text("<div><p>Only one short text.</p></div>") == "Only one short text."


def test_windows_cover_whole_texts():
    texts = [b"", b"x" * 256, b"y" * 257, b"z" * 1000]
    cells, used, begin = langid.windows(texts)
    assert used.tolist() == [1, 256, 256, 1, 256, 256, 256, 232] and begin.tolist() == [0, 1, 2, 4]
    assert b"".join(cells[4:].reshape(-1)[:1000].tobytes().split(b"\0")) == b"z" * 1000


def test_features_tell_repeats_and_shouting():
    features = quality.Features()
    number, value = features(b"la la la la")
    assert quality.REPEATED in number and quality.CONSTANT in number
    assert abs(float((value[:-1] ** 2).sum()) - 1) < 1e-5
    assert set(features(b"LOUD")[0]) > set(features(b"loud")[0])
    assert features(b"")[0].tolist() == [quality.CONSTANT]


def test_tokenizer_pieces_match_the_whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    texts = [
        "Don't STOP it'S 12½ a_b x<|endoftext|>y <|startoftext|>",
        "İstanbul ΣΑΣ Ünï ǅ 日本語 é ́a",
        "nb\xa0sp z\x85q \x1f\x00 tab\tnew\nline\x0bv",
        "",
    ]
    found = pack.WordIds(path).documents([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, pack.END_ID]


def test_normalised_matches_contract():
    assert re.sub("[\x20\x09-\x0D]", "", " a\tb\x0bc\x1c\xa0d\r\n") == "abc\x1c\xa0d"


PROSE = " ".join(f"word{i} of the story" for i in range(25))


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "comments-open", "header-full-width", "single related"])
@pytest.mark.parametrize("at", ["html", "body", "div", "article"])
def test_layout_names_on_frames_of_the_article(name, at):
    on = {t: f' class="{name}"' if t == at and (t, name) != ("article", "single related") else "" for t in ("html", "body", "div", "article")}
    page = (
        f"<html{on['html']}><body{on['body']}><nav><a href=/a>one</a></nav><div{on['div']}><article{on['article'] if 'open' in name else ''}>"
        f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article><div class='sidebar'><p>Other stories of ours to read.</p></div></div>"
        f"<div id='comments'><p>{PROSE} says a reader.</p></div><footer>someone</footer></body></html>"
    )
    assert extract.main_text(page) == f"Title {PROSE} {PROSE}"


@pytest.mark.parametrize("where", ["article", "main"])
@pytest.mark.parametrize("mark", ["id='discussion'", "id='related-work'", "id='legal-basis'", "class='search-methods'"])
def test_sections_of_an_article_named_by_their_subject(where, mark):
    page = (
        f"<body><{where}><h1 id='comments-on-x'>Title</h1><p>{PROSE}</p><section {mark}><h2 id='search'>Part</h2><p>{PROSE}</p></section>"
        f"<section id='comments'><p>I do not agree.</p></section><div class='share'><p>Tell others.</p></div></{where}></body>"
    )
    assert extract.main_text(page) == f"Title {PROSE} Part {PROSE}"


def test_frames_without_an_article():
    page = f"<body class='has-sidebar'><div id='page' class='no-sidebar'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div id='comments'><p>{PROSE}</p></div></body>"
    assert extract.main_text(page) == f"Title {PROSE} {PROSE}"
    cards = f"<body><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='related'><article><p>Another story.</p></article></div></body>"
    assert extract.main_text(cards) == f"Title {PROSE} {PROSE}"


def signs(page):
    """What the blocks' own evidence alone would keep."""
    return " ".join(b.text for b in extract.blocks(page)[0] if b.odds > 0)


LONG = "many words of a text that goes on and on about one thing after the other without a link in it"


def test_weak_blocks_follow_their_neighbours():
    """A sentence that is mostly a link stays in a text; a plain word in a list of links goes with the list."""
    page = f"<body><div><p>{LONG}.</p><p>See <a href=x>the report of it</a> too.</p><p>{LONG}!</p></div><ul><li><a href=a>First entry</a></li><li>Topics</li><li><a href=b>Second entry</a></li></ul></body>"
    assert extract.main_text(page) == f"{LONG}. See the report of it too. {LONG}!"
    assert "See the report" not in signs(page) and signs(page).endswith("Topics")


def test_dom_proximity_decides():
    """The same weak block between the same neighbours goes with the element that it shares with one of them."""
    weak, menu = "<p>See <a href=x>the report of it</a> all too, then.</p>", "<p><a href=a>First entry</a></p>"
    inside = f"<body><div><p>{LONG}</p><p>{LONG}</p>{weak}</div><div>{menu * 4}</div></body>"
    outside = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div>{weak}{menu * 4}</div></body>"
    assert "See the report" in extract.main_text(inside) and "See the report" not in extract.main_text(outside)


@pytest.mark.parametrize(
    "page",
    [
        "<body>" + "".join(f"<p>{LONG} {i}</p><div class=ad>ad {i}</div>" for i in range(3000)),
        "<div>t" * 6000,
        "<b>" * 5000 + "<p>text</p>" * 3000,
        "</i></p>" * 30_000 + "text",
        "<body>" + "".join(f"<p>{'a b' if i % 3 else ''}<a href=x>{'link' if i % 3 != 1 else ''} some</a></p>" for i in range(6000)),
    ],
)
def test_long_and_deep_pages_take_time_in_proportion(page):
    begin = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - begin < 10
