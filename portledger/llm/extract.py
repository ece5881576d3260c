"""Main text of web pages by a minimum cut.

A page is cut into blocks of text, each in an element of the DOM. Evidence of names, links and length gives
every block a cost of being called content and one of being called boilerplate, within bounds; these are its capacities to
the two terminals. Neighbours in the page are tied by smoothness edges, and so are a block and its element, and elements and
the ones around them, so that blocks near each other in the DOM hold together. The maximum flow separates
the page at the least total cost, and the blocks that stay on the content side are its text: a block whose own
evidence is weak follows those around it. Pages are independent, so this is one pass without an exchange.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Fixed values of HTML: elements without an end, elements whose text is not shown, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg canvas iframe object head title textarea select option button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: An open element of the key ends when one of these begins.
ENDS = {"p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul",
        "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr"}
ENDS = {tag: frozenset(by.split()) for tag, by in ENDS.items()}
#: Evidence of an element and of the words in its class, id or role, as log odds of content.
ELEMENT = {"article": 3.0, "main": 2.5, "nav": -8.0, "footer": -8.0, "header": -6.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0}
WORD = re.compile(
    r"(?P<bad>\b(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|foot(?:er)?\w*|header|masthead|"
    r"sidebar\w*|side|widget\w*|related|recommend\w*|share\w*|sharing|social|cookies?\w*|consent|notices?|popup|modal|"
    r"newsletter|subscribe|signup|login|comments?|comment\w*|disqus|repl(?:y|ies)|discussion|respond|copyright|legal|"
    r"pagination|pager|toolbar|search|skip|complementary|navigation|contentinfo|alert)\b)"
    r"|(?P<good>\b(?:article|main|content|post|entry|story|body|text)\b)",
    re.I,
)
GOOD_WORD, BAD_WORD = 1.0, -6.0
#: Names of sections in an article that may be what the section is about, where they are the whole name.
TITLES = frozenset(
    "discussion legal search notice notices consent copyright social sharing cookie cookies navigation recommendation "
    "recommendations alert replies".split()
)
ASIDE = frozenset("nav footer header aside menu dialog".split())
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
#: An article or main of this share of the page's text, or more, is what the page is about.
CORE = 0.2
#: Bound of all evidence against a text; two elements' worth, above what an article and long text can add up to.
LOWEST = -12.0
#: Constant, log odds for all text in links, and for a doubling of the words.
START, LINKED, LENGTH = 0.3, -4.0, 0.3
#: Bound of a block's evidence for both sides, on which its terminal capacities lie.
BOUND = 6.0
#: Smoothness between neighbours in the page, of a block with its element, and of an element with the one around it.
NEXT, NEAR, AROUND = 0.6, 1.0, 1.0


class Block(NamedTuple):
    element: int
    odds: float
    text: str


def named(tag: str, attributes: str, inside: bool) -> tuple[float, float]:
    """Evidence against and for, of the names of an element; ``inside`` an article or main, ids of headings are their
    titles, and a section is boilerplate only by a whole name that is no title."""
    bad = good = 0.0
    for kind, quoted in NAMES.findall(attributes):
        if inside and tag in HEADINGS and kind.lower() == "id":
            continue
        value = quoted.strip("\"'")
        for name in value.split() if inside and tag == "section" else [value]:
            words = re.sub(r"[_-]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))
            kinds = {m.lastgroup for m in WORD.finditer(words)}
            if inside and tag == "section" and (" " in words.strip() or words.lower() in TITLES):
                kinds.discard("bad")
            if "bad" in kinds:
                bad += BAD_WORD
            if "good" in kinds:
                good += GOOD_WORD
    return bad, good


class Element(NamedTuple):
    tag: str
    parent: int
    bad: float
    good: float


def above(elements: list[Element], number: int) -> Iterator[int]:
    """The element and those around it."""
    while number:
        yield number
        number = elements[number].parent


def evidence(elements: list[Element], sizes: list[int]) -> list[float]:
    """Log odds of the text in each element by its own and all outer names; ``sizes`` are characters of text.

    What holds the page's article, or most of its text and its heading, is its frame: names on it say how the page
    is laid out, not what its text is, and count only in favour.
    """
    cores: set[int] = set()
    inner = [0] * len(elements)  # text in an element and below
    for n in range(len(elements) - 1, -1, -1):
        inner[n] += sizes[n]
        if n:
            inner[elements[n].parent] += inner[n]
    whole = inner[0]
    beside = [False] * len(elements)  # in an element that stands beside the text
    for n, e in enumerate(elements):
        beside[n] = e.tag in ASIDE or (n > 0 and beside[e.parent])
    for kind in ("article", "main"):
        best = 0
        for n, e in enumerate(elements):
            if e.tag == kind and inner[n] >= max(CORE * whole, 1) and inner[n] > inner[best] * (best > 0):
                if (kind == "main" or not e.bad or e.good) and not beside[n]:
                    best = n
        cores |= {best} - {0}
    frames = {m for n in cores for m in above(elements, n)}
    title = next((n for n, e in enumerate(elements) if e.tag == "h1"), 0)
    if not cores:
        around = set(above(elements, title)) if title else set(range(len(elements)))
        frames = {n for n in around if 2 * inner[n] > whole}
    against, odds = [0.0] * len(elements), [0.0] * len(elements)
    for n, e in enumerate(elements):
        if n:
            own = ELEMENT.get(e.tag, 0.0)
            less = 0.0 if n in frames or e.tag in ("html", "body") else e.bad + min(own, 0.0)
            against[n] = against[e.parent] + less
            odds[n] = odds[e.parent] + (0.0 if e.bad and less else e.good) + max(own, 0.0)
    return [max(LOWEST, a) + o for a, o in zip(against, odds, strict=True)]


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Visible text between block-level markup, in page order, with its evidence, and the page's elements."""
    found: list[tuple[int, int, float, str]] = []  # innermost block-level element, innermost one, odds of its own, text
    elements = [Element("", 0, 0.0, 0.0)]
    sizes = [0]
    stack: list[tuple[str, int, bool]] = []  # element, its number, shown
    solid: list[int] = []  # places of block-level elements in the stack
    opened: Counter[str] = Counter()
    cores = 0  # open articles and mains
    parts: list[str] = []
    linked = at = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            share = min(1.0, linked / len(text))
            inner = stack[-1][1] if stack else 0
            sizes[inner] += len(text)
            found.append((stack[solid[-1]][1] if solid else 0, inner, START + LINKED * share + LENGTH * math.log2(1 + text.count(" ")), text))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and (not stack or stack[-1][2]):
            parts.append(text)
            linked += len(text) * (links > 0)

    def close(depth: int) -> None:
        nonlocal links, cores
        if solid and solid[-1] >= depth:
            flush()
        while solid and solid[-1] >= depth:
            solid.pop()
        opened.subtract(tag for tag, *_ in stack[depth:])
        links -= sum(tag == "a" for tag, *_ in stack[depth:])
        cores -= sum(tag in ("article", "main") for tag, *_ in stack[depth:])
        del stack[depth:]

    while (m := MARKUP.search(page, at)) is not None:
        take(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            least = solid[-1] + 1 if solid and tag in INLINE else 0
            for depth in range(len(stack) - 1, least - 1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag not in INLINE:
            for depth in reversed(solid):
                if tag in ENDS.get(stack[depth][0], ()):
                    close(depth)
                    break
                if stack[depth][0] not in ENDS:
                    break
            flush()
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        links += tag == "a"
        outer, shown = (stack[-1][1], stack[-1][2]) if stack else (0, True)
        shown = shown and tag not in UNSEEN and not HIDDEN.search(m[3])
        if tag not in INLINE:
            solid.append(len(stack))
        opened[tag] += 1
        stack.append((tag, len(elements), shown))
        elements.append(Element(tag, outer, *named(tag, m[3], cores > 0)))
        sizes.append(0)
        cores += tag in ("article", "main")
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
    take(page[at:])
    flush()
    weights = evidence(elements, sizes)
    return [Block(element, weights[inner] + odds, text) for element, inner, odds, text in found], elements


def graph(found: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal odds and smoothness edges: a node for each block, then for each element with text, of no odds."""
    odds = [min(BOUND, max(-BOUND, block.odds)) for block in found]
    edges = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    number: dict[int, int] = {}
    for i, block in enumerate(found):
        edge, n, tie = i, block.element, NEAR
        while n:
            known = n in number
            if not known:
                number[n] = len(odds)
                odds.append(0.0)
            edges.append((edge, number[n], tie))
            if known:
                break
            edge, n, tie = number[n], elements[n].parent, AROUND
    return odds, edges


def content_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut; ``odds`` are the terminal capacities, by sign.

    A node whose odds outweigh all its edges is on their side in a least cut: its edges become odds of its
    neighbours. This settles most nodes, one after the other; the flow decides about the rest.
    """
    ties: list[dict[int, float]] = [{} for _ in odds]
    for a, b, capacity in edges:
        if a != b:
            ties[a][b] = ties[a].get(b, 0.0) + capacity
            ties[b][a] = ties[b].get(a, 0.0) + capacity
    odds, weight = list(odds), [sum(t.values()) for t in ties]
    side: list[bool | None] = [None] * len(odds)
    ready = [i for i, value in enumerate(odds) if abs(value) >= weight[i] and value]
    while ready:
        i = ready.pop()
        if side[i] is not None:
            continue
        side[i] = odds[i] > 0
        for j, capacity in ties[i].items():
            if side[j] is None:
                odds[j] += capacity if side[i] else -capacity
                weight[j] -= capacity
                if abs(odds[j]) >= weight[j] - 1e-12 and odds[j]:
                    ready.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    for i, content in zip(rest, flow(rest, odds, ties), strict=True):
        side[i] = content
    return side


def flow(rest: list[int], odds: list[float], ties: list[dict[int, float]]) -> list[bool]:
    """Source sides of the nodes of ``rest`` by a maximum flow along ever longer shortest paths, many in a round."""
    place = {i: n for n, i in enumerate(rest)}
    source, sink, size = len(rest), len(rest) + 1, len(rest) + 2
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(size)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for n, i in enumerate(rest):
        if odds[i] > 0:
            tie(source, n, odds[i], 0.0)
        elif odds[i] < 0:
            tie(n, sink, -odds[i], 0.0)
        for j, capacity in ties[i].items():
            if place.get(j, -1) > n:
                tie(n, place[j], capacity, capacity)
    while True:
        far = [-1] * size
        far[source], wave = 0, [source]
        while wave:
            following = []
            for a in wave:
                for e in out[a]:
                    if room[e] > 1e-9 and far[to[e]] < 0:
                        far[to[e]] = far[a] + 1
                        following.append(to[e])
            wave = following
        if far[sink] < 0:
            return [far[n] >= 0 for n in range(len(rest))]
        turn, path, at = [0] * size, [], source
        while True:
            if at == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and far[to[e]] == far[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(out[at][turn[at]])
                at = to[path[-1]]
            elif path:
                far[at] = -1
                at = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str) -> str:
    """Content blocks of a page, joined by one space."""
    found, elements = blocks(page)
    if not found:
        return ""
    side = content_side(*graph(found, elements))
    return " ".join(block.text for block, content in zip(found, side) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page gives an empty text; null ids and urls stay; repeated rows are read each; other columns
    are ignored; an empty table gives no rows. Long and deeply nested pages are read whole, in a time that grows with them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page.decode("utf-8", "replace")) for page in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(task, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
