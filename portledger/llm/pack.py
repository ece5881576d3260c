"""Packing of token sequences by minimum bin slack.

A document longer than a sequence fills whole sequences first; what remains goes to a pool, a
multiset of remaining lengths. Each next sequence starts with the longest remainder, and a subset-sum
program over a bitset (bit ``s`` is set when some sub-multiset sums to ``s``) finds how close the others
can come to its capacity; walking back through the bitsets gives how many of each length to take. Slack
that no sub-multiset fills is filled by cutting the longest remainder. At the end of a task the tokens
left are cut into sequences of powers of two, which need no padding.

Tasks pack what they read and exchange nothing: memory is the pool plus one batch, and a task that is
run again on the same split gives the same sequences.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import WHITE_BYTES, as_bytes, doc_rows, slices

CAPACITY = 4096
#: Remainders kept before sequences are filled; more give the subset sum more choice.
POOL = 256
#: Id after each document.
END_ID = 2
#: Words whose ids a task remembers before it forgets those that a batch doesn't hold.
CACHE_WORDS = 400_000
#: Stands between the ids of words; ids below 2 ** 24 never hold these bytes, at whatever place.
BETWEEN = b"\xff" * 4

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint"
)


def _plain_pieces() -> re.Pattern:
    """What the tokenizer's own pattern cuts lower-cased words into, for letters below U+0250, and single spaces."""
    kinds = {"L": "", "N": ""}
    for char in map(chr, range(0x250)):
        kind = unicodedata.category(char)[0]
        if kind in kinds:
            kinds[kind] += char
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(f" |'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


_BLACK = np.ones(256, dtype=bool)
_BLACK[list(WHITE_BYTES)] = False


def distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, which of them stands at each place, and how many places each text has."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    black = _BLACK[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    begins = (ends - sizes)[sizes > 0]
    first[begins] = black[begins]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    data, first = data[black], first[black]
    offsets = np.append(np.flatnonzero(first), len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = words.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), counts


class WordIds:
    """Ids of whole texts, from remembered ids of words and of the pieces words are cut into.

    The tokenizer never joins text across ASCII white space, so words are encoded one by one, and each distinct
    word of a batch is looked up once. A word not seen before is lower-cased and cut here if all its characters
    lie below U+0250, where the tokenizer's normalisation is lower-casing alone, and its pieces go to the
    tokenizer's model in one call a batch; any other word, and one that may hold a special token, goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([])
        # The model reads bytes as characters: printable ones as themselves, the others as those from U+0100 on.
        known, later = set(pre_tokenizers.ByteLevel.alphabet()), iter(range(256, 512))
        self.characters = np.array([b if chr(b) in known else next(later) for b in range(256)], dtype="<u4")
        self.characters[ord(" ")] = ord(" ")
        # The last id of a piece, and no other, is one of these.
        suffix = self.model.model.end_of_word_suffix
        self.last = np.zeros(self.model.get_vocab_size(), dtype=bool)
        self.last[[i for token, i in self.model.get_vocab(False).items() if token.endswith(suffix)]] = True
        self.plain, self.other = _plain_pieces(), re.compile("[\x00-\x1f\x7f-\xa0\u0250-\U0010ffff]|<\\|")
        # Ids as little-endian unsigned 32-bit bytes, so that a text is their concatenation.
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {" ": BETWEEN}

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.pieces))
        if not new:
            return
        if len(self.pieces) + len(new) > CACHE_WORDS:
            self.pieces = {piece: self.pieces[piece] for piece in pieces.intersection(self.pieces)} | {" ": BETWEEN}
        text = self.characters[np.frombuffer(" ".join(new).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        encoded = self.model.encode_batch_fast([text.split(" ")], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(encoded.ids, dtype="<u4")
        ends = 4 * np.flatnonzero(self.last[ids]) + 4
        ids, begin = ids.tobytes(), 0
        for piece, end in zip(new, ends.tolist(), strict=True):
            self.pieces[piece] = ids[begin:end]
            begin = end

    def _learn(self, words: list[bytes]) -> None:
        """Plain words are cut and put together as one text, with no step of its own for each word."""
        text = b" ".join(words).decode("utf-8", "replace")
        if self.other.search(text):
            plain = []
            for word, part in zip(words, text.split(" "), strict=True):
                if self.other.search(part):
                    ids = self.whole.encode(part, add_special_tokens=False).ids
                    self.words[word] = np.array(ids, dtype="<u4").tobytes()
                else:
                    plain.append(word)
            words, text = plain, b" ".join(plain).decode()
        if words:
            cut = self.plain.findall(text.lower())
            self._learn_pieces(set(cut))
            ids = b"".join(map(self.pieces.__getitem__, cut)).split(BETWEEN)
            self.words.update(zip(words, ids, strict=True))

    def documents(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text and the closing id, unsigned 32 bit, little-endian."""
        distinct, which, counts = distinct_words(texts)
        new = [word for word in distinct if word not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {word: self.words[word] for word in distinct if word in self.words}
        self._learn(new)
        held = [*map(self.words.__getitem__, distinct), np.array([END_ID], dtype="<u4").tobytes()]
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        begins = np.cumsum(lengths) - lengths
        # The closing id is one more word after those of each text.
        which = np.insert(which, np.cumsum(counts), len(distinct))
        lengths = lengths[which]
        ends = np.cumsum(lengths)
        ids = ids[np.repeat(begins[which] - ends + lengths, lengths) + np.arange(lengths.sum())]
        begin = 0
        for end in ends[np.cumsum(counts + 1) - 1].tolist():
            yield ids[begin:end].copy()  # what waits in a pool must not hold the whole batch
            begin = end


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker, so that later ones find the words of earlier ones."""
    return WordIds(path)


@contextmanager
def uncollected() -> Iterator[None]:
    """Packing makes no reference cycles; the collector would only walk the split words again and again.

    It runs again for whatever the Python worker does next.
    """
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``capacity`` from below."""
    mask = (1 << (capacity + 1)) - 1
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        left, take = counts[length], 1
        while left and not reach >> capacity & 1:
            take = min(take, left)
            if take * length > capacity:
                break
            layers.append((length, take, reach))
            reach |= reach << take * length & mask
            left, take = left - take, 2 * take
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= take * length
            taken[length] = taken.get(length, 0) + take
    return taken


class Packer:
    """Pieces of one task. A remainder is (doc_id, start, ids, tokens of its document)."""

    def __init__(self, first_id: int, capacity: int, pool: int):
        self.next_id, self.capacity, self.limit = first_id, capacity, pool
        self.pool: dict[int, deque] = {}
        self.size = 0

    def push(self, item: tuple) -> None:
        if length := len(item[2]):
            self.pool.setdefault(length, deque()).append(item)
            self.size += 1

    def pop(self, length: int) -> tuple:
        queue = self.pool[length]
        item = queue.popleft()
        if not queue:
            del self.pool[length]
        self.size -= 1
        return item

    def sequence(self, items: list[tuple]) -> Iterator[tuple]:
        total = sum(len(ids) for _, _, ids, _ in items)
        padded = total if total & (total - 1) == 0 else self.capacity
        offset = 0
        for doc_id, start, ids, tokens in items:
            yield doc_id, start, len(ids), ids.tobytes(), tokens, self.next_id, offset, padded
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self.sequence([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        self.push((doc_id, whole, ids[whole:], len(ids)))
        while self.size > self.limit:
            yield from self.fill()

    def fill(self) -> Iterator[tuple]:
        items = [self.pop(max(self.pool))]
        slack = self.capacity - len(items[0][2])
        for length, n in closest_fill({k: len(v) for k, v in self.pool.items()}, slack).items():
            items += [self.pop(length) for _ in range(n)]
            slack -= n * length
        if slack and self.pool:
            doc_id, start, ids, tokens = self.pop(max(self.pool))
            items.append((doc_id, start, ids[:slack], tokens))
            self.push((doc_id, start + slack, ids[slack:], tokens))
        yield from self.sequence(items)

    def finish(self) -> Iterator[tuple]:
        while sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            yield from self.fill()
        rest = deque(self.pop(length) for length in sorted(self.pool, reverse=True) for _ in range(len(self.pool[length])))
        left = sum(len(ids) for _, _, ids, _ in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left, items = left - room, []
            while room:
                doc_id, start, ids, tokens = rest.popleft()
                items.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    rest.appendleft((doc_id, start + room, ids[room:], tokens))
                room -= len(items[-1][2])
            yield from self.sequence(items)


def _table(pieces: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [field.split()[0] for field in PIECES.split(", ")]
    columns = zip(*pieces, strict=True) if pieces else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """Pieces of all documents: where each starts in its document and in its sequence, and its ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is one closing
    id; a null ``doc_id`` stays null; repeated rows are packed each; an empty table gives no pieces.
    ``ids`` holds little-endian unsigned 32-bit ids. ``sequence_length`` is the padded length.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, pool)
        with uncollected():
            for batch in slices(batches, 1024):
                pieces: list[tuple] = []
                texts = as_bytes(batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.documents(texts), strict=True):
                    pieces += packer.add(doc_id, ids)
                yield _table(pieces)
            yield _table(list(packer.finish()))

    return doc_rows(docs, "doc_id", "text").mapInArrow(task, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_length",
    )
