"""Chat formatting at the level of tokens.

Role and text of a turn are encoded apart and put between reserved ids that no text can produce, so a
control string inside a text never becomes control. As strings, such places are also escaped with a
backslash, reversibly. The loss mask of a batch is the running sum of +1 where an assistant's text begins and
-1 where it ends. Turns are formatted where they are read; a conversation is its turns in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portledger.llm.common import as_bytes, slices

#: The template's control strings; their ids follow the vocabulary's.
END_OF_TEXT_ID, START_ID, BREAK_ID, END_ID = 50256, 50257, 50258, 50259
START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_sep|im_end|endoftext)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_sep|im_end|endoftext)\|>")
LOSS_ROLE = "assistant"

FORMATTED = "conv_id bigint, turn bigint, ids array<int>, loss_mask array<boolean>, formatted string"


def escape(text: str) -> str:
    """One backslash more inside whatever looks like a control string."""
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def encoding(path: str):
    """The byte-level tokenizer of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters of one stretch of white space that are split at once; the pattern's engine can't take a million.
SPACES = 20_000
LONG_SPACES = re.compile(rf"\s{{{SPACES},}}")


def encode(coder, text: str) -> list[int]:
    """Ids of a text of any length; stretches of more than SPACES white characters are encoded in pieces."""
    cuts = [cut for m in LONG_SPACES.finditer(text) for cut in range(m.start() + SPACES, m.end() - 1, SPACES)]
    if not cuts:
        return coder.encode_ordinary(text)
    return [i for a, b in zip([0, *cuts], [*cuts, len(text)]) for i in coder.encode_ordinary(text[a:b])]


def assemble(roles: list[list[int]], texts: list[list[int]], loss: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of turns one after the other, and where each turn begins."""
    head = np.array([len(r) + 2 for r in roles], dtype=np.int64)
    body = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(head + body + 1)])
    ids = np.empty(begin[-1], dtype=np.int32)
    for at, role, text in zip(begin.tolist(), roles, texts, strict=False):
        ids[at : at + len(role) + len(text) + 3] = [START_ID, *role, BREAK_ID, *text, END_ID]
    steps = np.zeros(begin[-1] + 1, dtype=np.int8)
    on = np.asarray(loss, dtype=bool) & (body > 0)
    np.add.at(steps, (begin[:-1] + head)[on], 1)
    np.add.at(steps, (begin[:-1] + head + body)[on], -1)
    return ids, np.cumsum(steps[:-1], dtype=np.int8) > 0, begin


def format_turns(turns: DataFrame, ranks: str) -> DataFrame:
    """Each turn as ids, loss mask and string; a conversation is the concatenation in order of ``turn``.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. Null roles and texts count as
    empty, null ids and turns stay. Repeated rows are formatted each; an empty table gives no rows. Texts of any
    length are formatted whole; only white space of more than SPACES characters in a row gets other ids than in one piece.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks)
        for batch in slices(batches):
            plain = [value.decode("utf-8", "replace") for value in as_bytes(batch.column(2))]
            roles = [escape(role) for role in plain]
            texts = [escape(value.decode("utf-8", "replace")) for value in as_bytes(batch.column(3))]
            ids, mask, begin = assemble(
                [encode(coder, role) for role in roles],
                [encode(coder, text) for text in texts],
                [role == LOSS_ROLE for role in plain],
            )
            offsets = pa.array(begin, pa.int32())
            strings = [f"{START}{role}{BREAK}{text}{END}" for role, text in zip(roles, texts, strict=True)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.ListArray.from_arrays(offsets, pa.array(ids)),
                pa.ListArray.from_arrays(offsets, pa.array(mask)),
                pa.array(strings, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "ids", "loss_mask", "formatted"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(task, FORMATTED)


def read_turns(formatted: DataFrame, ranks: str) -> DataFrame:
    """Role, text and text under the loss mask, decoded from the ids alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks)

        def text(ids: np.ndarray) -> str:
            return unescape(coder.decode_bytes(ids.tolist()).decode("utf-8", "replace"))

        for batch in slices(batches):
            rows = []
            for ids, mask in zip(batch.column(2), batch.column(3), strict=True):
                ids = ids.values.to_numpy()
                mask = mask.values.to_numpy(zero_copy_only=False)
                start, cut, end = (int(np.flatnonzero(ids == mark)[0]) for mark in (START_ID, BREAK_ID, END_ID))
                rows.append((text(ids[start + 1 : cut]), text(ids[cut + 1 : end]), text(ids[mask]) if mask.any() else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in columns), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "loss_text", "formatted_chars"])

    chars = F.char_length("formatted").cast("long").alias("formatted_chars")
    return formatted.select("conv_id", "turn", "ids", "loss_mask", chars).mapInArrow(
        task, "conv_id bigint, turn bigint, role string, text string, loss_text string, formatted_chars bigint"
    )


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests of each conversation from read-back turns with ``formatted_chars``.

    A digest reads a conversation in order, so its turns meet in one task, but as a sorted stream: memory
    is one batch and two hash states, however long a conversation is. Equal turns are ordered by role and text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, open_ = None, None, False

        def row() -> tuple:
            return at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            for conv, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if not open_ or conv != at:
                    if open_:
                        done.append(row())
                    at, state, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            yield _digest_batch(done)
        if open_:
            yield _digest_batch([row()])

    sort = ["conv_id", "turn", "role", "text"]
    return turns.select(*sort[:2], "role", "text", "loss_text", "formatted_chars").repartition("conv_id").sortWithinPartitions(*sort).mapInArrow(task, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
