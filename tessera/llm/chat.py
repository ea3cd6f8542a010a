"""Chat formatting with loss masks (operator 5).

A conversation is rendered as one string, turn after turn::

    <turn>role
    text</turn>

In roles and texts a backslash is doubled and ``<`` becomes a backslash and ``l`` (in roles
a line end becomes a backslash and ``n``), so no marker can stand inside a text and the
rendering can be undone.
The string is encoded once, with offsets; the assistant texts are the loss spans, and each
token's offsets are set against the sorted spans by binary search: a token is under the loss
mask when it shares characters with a span, and the mask holds the shared part.

``read_back`` gets turns and masked text from (formatted, mask) alone.

Turns are sorted within partitions and streamed, so a conversation of very many turns costs
time in its task and no memory beyond ``SEGMENT`` characters: a rendering that long is cut
at the next turn's beginning, and each segment is encoded by itself.  Its digests are
running digests.  Rows by turn; ties by role, then text; NULL turn first, NULL text empty,
NULL role empty; rows of a NULL conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import chunks

OPEN, CLOSE = "<turn>", "</turn>\n"
LOSS_ROLE = "assistant"
SEGMENT = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """(formatted, loss spans): spans (start, end) of the assistant texts, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Rows (token, start, end): the characters of each token under the mask.  A token may
    reach over several spans; tokens that share one character (parts of it) share its row's
    characters too."""
    if not len(spans) or not len(offsets):
        return np.zeros((0, 3), np.int64)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")       # first span that ends behind the token's start
    last = np.searchsorted(spans[:, 0], offsets[:, 1], side="left")         # spans that begin before the token's end
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(offsets)), n)
    span = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.maximum(offsets[token, 0], spans[span, 0])
    end = np.minimum(offsets[token, 1], spans[span, 1])
    some = end > start
    return np.stack([token[some], start[some], end[some]], axis=1)


def masked_text(formatted: str, rows: np.ndarray) -> str:
    """The characters under the mask, each once, unescaped."""
    if not len(rows):
        return ""
    start, end = rows[:, 1], rows[:, 2]
    reach = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    start = np.maximum(start, reach)
    return unescape("".join(formatted[a:b] for a, b in zip(start.tolist(), end.tolist()) if b > a))


_TURN = re.compile(r"<turn>([^\n]*)\n([^<]*)</turn>\n")


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


_LIBRARY: dict = {}


def _tokenizer(path: str):
    if path not in _LIBRARY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True          # their strings in a text are ordinary text
        _LIBRARY[path] = t
    return _LIBRARY[path]


SEGMENTS = ("conv_id long, segment long, formatted string, ids array<int>, loss array<boolean>, "
            "mask_token array<int>, mask_start array<int>, mask_end array<int>")


def formatted(conversations: DataFrame, path: str) -> DataFrame:
    """Rows ``SEGMENTS``: the rendered conversation, its token ids, the tokens' loss mask and
    the masked characters of each masked token.  One segment unless a conversation's
    rendering passes ``SEGMENT`` characters."""
    ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("ids", ints),
                        ("loss", flags), ("mask_token", ints), ("mask_start", ints), ("mask_end", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _tokenizer(path)

        def segment(conv: int | None, n: int, turns: list[tuple[str, str]]) -> tuple:
            text, spans = render(turns)
            e = library.encode(text, add_special_tokens=False)
            rows = mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), spans)
            loss = np.zeros(len(e.ids), dtype=bool)
            loss[rows[:, 0]] = True
            return (conv, n, text, e.ids, loss, *rows.T.astype(np.int32))

        def batch_of(ready: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), schema.types)], schema=schema)

        ready, held = [], 0
        key, n, turns, size = None, 0, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if turns and (row["conv_id"] != key or size >= SEGMENT):
                    ready.append(segment(key, n, turns))
                    held += size
                    n, turns, size = n + 1, [], 0
                    if held >= SEGMENT:
                        yield batch_of(ready)
                        ready, held = [], 0
                if row["conv_id"] != key:
                    key, n = row["conv_id"], 0
                turns.append((row["role"] or "", row["text"] or ""))
                size += len(turns[-1][1]) + len(turns[-1][0]) + 16
        if turns:
            ready.append(segment(key, n, turns))
        if ready:
            yield batch_of(ready)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per
    conversation, read back from ``segments`` (of ``formatted``) alone."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> list:
            return [key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        started, done = False, []
        key = n_turns = loss_chars = chars = 0
        turns = loss = hashlib.sha256()
        for piece in chunks(batches, "formatted"):
            marks = [piece.column(i) for i in (3, 4, 5)]
            for i, (conv, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                if not started or conv != key:
                    if started:
                        done.append(close())
                    started, key, n_turns, loss_chars, chars = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8"))
                    n_turns += 1
                under = masked_text(text, np.stack([m[i].values.to_numpy() for m in marks], axis=1))
                loss.update(under.encode("utf-8"))
                loss_chars += len(under)
                chars += len(text)
        if started:
            done.append(close())
        if done:
            cols = [pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*done))]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in names.split(", ")])

    ordered = segments.select("conv_id", "segment", "formatted", "mask_token", "mask_start", "mask_end") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, names)
